import random

import pytest

CLASH = ["id", "key", "size", "sig", "node", "h", "bucket", "rank", "slot", "tokens", "words", "features", "label", "n_words", "score"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def texts():
    """(doc_id, text, source): copies, near copies, shared passages, odd and empty texts, one long text."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = []

    def make(n):
        return [r.choice(vocabulary) for _ in range(n)]

    base, passage = make(120), make(45)
    for k in range(30):
        words = make(r.randint(1, 150))
        if k % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        out.append(" ".join(words))
    for k in range(25):  # near copies with more and more edits
        words = list(base)
        for _ in range(k // 3):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    out += [" ".join(base)] * 6
    out += [" ".join(base).upper(), "  ".join(base) + "\n", " ".join(base[:60] + base[:60])]
    out += [None, "", " \n\t ", "one", "two words", "now three words", "Now THREE words", "four little words here", "a a a a a a a a a a a a a a a a a a a a a a a a a", "ab " * 300]
    out += ["\x0b\x0cx\x1fy z w   q", "…!? ###", "£ × ÷", "don't stop, OK? <|endoftext|> 12 3.4", " ".join(make(9000))]
    rows = [(k, t, ("s1", "s2", None, "s1", "s1")[k % 5]) for k, t in enumerate(out)]
    rows += [(3, out[3], "s1"), (3, out[3], "s1"), (None, "a text without a key and some more words", "s2")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def small():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, small):
    rows = [(i, t, "en", s, len(t or ""), *("x" for _ in CLASH)) for i, t, s in small]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
