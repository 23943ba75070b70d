import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.functions import fold as python
from siftline.functions import text
from siftline.functions.numbers import rounded

HARD = "_foo foo_ foo__bar a-b-c a--b multi-threaded café x–y don’t don't ½ ﬁn ™ C++ node.js 3.14 İstanbul straße हि A_B-c -lead trail- K 9a 𝐀x"
TOKENS = "a-b-c a b multi-threaded cafe xy dont don t 12 fin tm c node js 3 14 istanbul strae a_b-c lead trail k 9a ax".split()

STEMS = dict(
    algorithms="algorithm", learning="learn", databases="database", optimization="optimize", classes="class", studies="study", ties="tie", running="run", string="str",
    stopped="stop", need="need", amazingly="amaz", markedly="mark", relational="relate", educational="educate", conditional="conditi", information="informe", operations="opere",
    selection="select", development="develop", darkness="dark", readable="read", possible="poss", quickly="quick", syllabus="syllabu", structures="structure", news="new", series="sery", bus="bus",
)


def test_tokens(spark):
    df = spark.createDataFrame([(0, HARD), (1, None), (2, ""), (3, "a\n\tb " * 5000)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", text.tokens(F.col("t")).alias("w")).collect()}
    assert got[0] == TOKENS == python.tokenize(HARD)
    assert got[1] == got[2] == [] and len(got[3]) == 10000


def test_fold_of_every_character(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(points[k : k + 2000]) for k in range(0, len(points), 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.f for r in df.select("i", text.fold(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts] == [python.fold(t) for t in texts]


def test_runs_give_the_same_tokens():
    for t in (HARD, "a-_b x_-y --_ z", "ÀÉ-î_õ", "a\x00b", "tab\tnew\nline"):
        assert [w for r in python.runs(t) for w in ([r.decode()] if r.isalnum() else python.tokens_of_run(r))] == python.tokenize(t)


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "w string, s string")
    for out in (df.select("s", text.stem(F.col("w")).alias("got")), text.with_stem(df, "w", "got")):
        assert all(r.s == r.got for r in out.collect())
    assert all(python.stem(w) == s for w, s in STEMS.items())


@pytest.mark.parametrize("x,digits,want", [(0.14275, 4, 0.1427), (2.5, 0, 3.0), (-1.25, 1, -1.3), (0.0, 2, 0.0)])
def test_rounded(spark, x, digits, want):
    assert spark.createDataFrame([(x,)], "x double").select(rounded(F.col("x"), digits)).first()[0] == want
