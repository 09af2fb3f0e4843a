import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import tokens

from .helpers import docs

TEXTS = ["", " ", "  two  spaces ", "plain words, here.\nNew line", "trailing ", " leading", "a\n b", "tab\tand\r\nreturn", "it's he'll 'quoted' '''s", "naïve café Straße", "日本語 text", "emoji 😀 x", "<|endoftext|> inside", "x" * 5000, "12,345.67 $%^", "\x0b\x0c", "a b", "\u0085z"]


@pytest.fixture(scope="module")
def pair():
    p = tokens.public_paths()
    return tokens.Encoder(**p), Tokenizer.from_file(p["path"])


def test_ids_are_those_of_tokenizers(pair):
    fast, plain = pair
    for texts in (TEXTS, TEXTS[::-1], [a + " " + b for a in TEXTS for b in TEXTS]):
        for text, ids in zip(texts, fast.encode(texts)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_a_small_cache_changes_nothing(pair, monkeypatch):
    fast, plain = pair
    monkeypatch.setattr(tokens, "CACHE", 3)
    monkeypatch.setattr(tokens, "PART", 10)
    for _ in range(3):
        assert [x.tolist() for x in fast.encode(TEXTS)] == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_byte_lengths_add_up(pair):
    fast, _ = pair
    for text, ids in zip(TEXTS, fast.encode(TEXTS)):
        assert fast.byte_len[ids].sum() == len(text.encode())


def test_each_token_goes_to_one_section(spark):
    df = docs(spark, [(1, "One line\nand another\n\n日本語 end"), (2, None), (3, ""), (3, ""), (None, "x")])
    rows = tokens.attribute_tokens(df, **tokens.public_paths(), fields=["source", "text"]).collect()
    plain = Tokenizer.from_file(tokens.public_paths()["path"])
    for doc, text in ((1, "src0\nOne line\nand another\n\n日本語 end"), (None, "src0\nx"), (2, "src0\n")):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.n_tokens for r in own) == len(plain.encode(text, add_special_tokens=False).ids) == own[0].doc_tokens
        assert own[0].start == 0 and own[-1].end == len(text) and all(a.end == b.start for a, b in zip(own, own[1:]))
    assert sum(r.doc_id == 3 for r in rows) == 4


def test_rules_for_crossing_tokens():
    lengths, ids = np.array([0, 5, 3]), np.array([1, 2])
    edges = np.array([0, 2, 6, 8])
    dealt = lambda rule: [x.tolist() for x in tokens._dealt(ids, lengths, "abcdefgh", edges, rule)]
    assert dealt("first") == [[1, 1, 0], [1, 1, 0]]
    assert dealt("last") == [[0, 1, 1], [0, 1, 1]]
    assert dealt("most") == [[0, 1, 1], [0, 1, 1]]


def test_empty_table_and_bad_rule(spark):
    empty = docs(spark, [])
    assert tokens.attribute_tokens(empty, **tokens.public_paths(), fields=["text"]).count() == 0
    with pytest.raises(ValueError):
        tokens.attribute_tokens(empty, **tokens.public_paths(), fields=["text"], rule="none")


def test_each_token_goes_where_the_tokenizer_says_that_it_lies():
    """Against the offsets that the tokenizer itself reports, with its trimmed blanks given back."""

    enc = tokens.encoder(**tokens.public_paths())
    rng = random.Random(12)
    pieces = ["alpha beta", "né 日本", "x\ty  z", "", "12,345.67 it's", "🙂 ok", " lead", "trail "]
    for _ in range(60):
        parts = [rng.choice(pieces) for _ in range(rng.randrange(1, 7))]
        text = "\n".join(parts)
        size = [len(p) + 1 for p in parts]
        size[-1] -= 1
        edges = np.concatenate([[0], np.cumsum(size)])
        e = enc.whole.encode(text, add_special_tokens=False)
        assert enc.encode([text])[0].tolist() == e.ids
        want = {rule: [0] * len(parts) for rule in tokens.RULES}
        of = lambda at: max(k for k in range(len(parts)) if edges[k] <= at)
        for (a, b), token in zip(e.offsets, e.tokens):
            lead = len(token) - len(token.lstrip("Ġ"))
            while lead and a and text[a - 1] == " " and text[a:b].lstrip(" ") == text[a:b]:
                a, lead = a - 1, lead - 1
            a, b = (a, max(b, a + 1))
            held = [min(b, int(edges[k + 1])) - max(a, int(edges[k])) for k in range(len(parts))]
            want["first"][of(a)] += 1
            want["last"][of(b - 1)] += 1
            want["most"][held.index(max(held))] += 1
        for rule in tokens.RULES:
            got, _ = tokens._dealt(enc.encode([text])[0], enc.byte_len, text, edges, rule)
            assert got.tolist() == want[rule], (text, rule, e.tokens, e.offsets)
