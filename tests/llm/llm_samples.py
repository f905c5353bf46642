"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

LANGS = ("de", "en")
SYLLABLES = {"de": ["sch", "ung", "keit", "ei", "ber", "lich"], "en": ["the", "tion", "ing", "wh", "oo", "ed"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def documents(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars, _key): the last is a column that operators don't know."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = LANGS[i % 2]
        lines = [prose(rng, lang, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["  Shared LINE\t", "shared line", "Shared line "]))
        rows.append((3 * i, "\n".join(lines), lang, f"s{min(i % 7, 3)}", None, i))
    long_text = prose(rng, "en", 30_000)
    rows += [
        (1001, None, "en", "s0", 0, 1),
        (1002, "", "de", None, 0, 1),
        (1003, " \t\n ", None, "s0", 4, 1),
        (1004, long_text, "en", "s1", None, None),
        (1005, long_text[:-40] + " changed ending here", "en", "s1", 5, 2),
        (1006, "12345 !! ??", "en", "s2", 11, 2),
        (1007, "Ünï çödé ẞ İ \U0001f600 x y", None, "s2", 1, 2),
        (1008, "a  b   c\n\n  d \n", "de", "s3", 1, 2),
        (None, "no id but words of its own", "en", "s0", 1, 2),
        (None, None, None, None, None, None),
        (rows[5][0], rows[5][1], *rows[5][2:]),  # a row repeated
        (rows[6][0], "another text under an id in use", "en", "s0", 3, 3),
        (1009, rows[8][1], "en", "s0", 3, 3),  # copies
        (1010, rows[8][1], "en", "s0", 3, 3),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long"


def table(spark, rows=None, parts=5):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
