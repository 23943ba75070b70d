"""The fixed rules of text analysis, for Spark expressions and for Python alike."""

from __future__ import annotations

#: Runs of letters and digits; single hyphens and underscores may join them.
TOKEN_PATTERN = r"\b[a-zA-Z0-9]+(?:[-_][a-zA-Z0-9]+)*\b"

# Stop words of English, and words that only the web's addresses hold.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down
during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here
here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself
let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves
out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the
their theirs them themselves then there there's these they they'd they'll they're they've this those
through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll
you're you've your yours yourself yourselves
http https www com edu org ac in html php
""".split()

# The stages of the stemmer. A rule is (ending, least length, letters cut, letters added);
# of each stage the first rule that fits is applied, and lengths are those the stage begins with.
PLURALS = [("sses", 4, 2, ""), ("ies", 5, 3, "y"), ("ss", 2, 0, ""), ("s", 4, 1, "")]
VERBS = [("ingly", 7, 5, ""), ("edly", 6, 4, ""), ("ing", 6, 3, ""), ("ed", 5, 2, "")]
#: After these verb endings, one of two equal letters goes as well.
UNDOUBLED, DOUBLES = ("ing", "ed"), ("bb", "dd", "gg", "mm", "nn", "pp", "rr", "tt")
DERIVED = [
    ("ization", 9, 7, "ize"), ("ational", 9, 5, "e"), ("tional", 8, 4, ""), ("ation", 7, 5, "e"), ("tion", 6, 3, ""),
    ("ment", 7, 4, ""), ("ness", 7, 4, ""), ("able", 7, 4, ""), ("ible", 7, 4, ""), ("ly", 5, 2, ""),
]
#: Words up to this length are their own stem.
UNSTEMMED = 3
