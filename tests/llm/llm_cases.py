"""Rows and comparisons that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, hits string, _terms int, c0 string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    syllables = ["the", "on", "er", "ándo", "ßung", "ré", "in", "st", "wh", "èque"]
    pool = ["".join(r.choice(syllables) for _ in range(1 + k % 3)) for k in range(vocabulary)]
    out = [r.choice(pool) + r.choice(["", "", "", ",", "."]) for _ in range(words)]
    return " ".join(out)


def edited(text: str, seed: int, times: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(times):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, "x", 2, "y")


def corpus() -> list[tuple]:
    """Texts of all kinds: none, empty, blank, long, odd characters, exact and near copies, shared passages, personal data."""
    r = random.Random(1)
    texts = [None, "", " \n\t ", "a", "One two", "three THREE three", "x" * 3000, "ab" * 900, "日本語 テキスト 😀 'tis don't  it's", "\x1c\x85  a"]
    base = [prose(k, 60 + 15 * k) for k in range(12)]
    texts += base
    texts += [base[3], base[3], base[5], None, ""]
    texts += [edited(base[9], s, 1 + s % 4) for s in range(14)]
    passage = prose(99, 110)
    texts += [f"{prose(200 + k, 30)} {passage} {prose(300 + k, 30)}" for k in range(12)]
    texts += [f"{prose(400 + k, 25)} bob.42@mail{k % 2}.example.com calls +1 (368) 555-0098 or 42.144.35.254 card 4111 1111 1111 1111 zorblax" for k in range(6)]
    texts += [" ".join([prose(7, 9)] * 120), prose(500, 4000)]
    rows = [row(k * 3 if k != 8 else None, t, r.choice(["en", "de", None])) for k, t in enumerate(texts)]
    return [*rows, row(33, "again the same number"), row(None, None), row(None, base[4])]


def by_text(frame, docs):
    """Rows of a result that have doc_id and no text, next to the input rows with the same doc_id, both sorted."""
    got = {}
    for r in frame.collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in texts.items()}
    return got, texts


def checked(frame, docs, columns, expected):
    """Rows agree with expected(text), as multisets per doc_id."""
    got, texts = by_text(frame, docs)
    for key, rows in got.items():
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(expected(t or "") for t in texts[key]), key
