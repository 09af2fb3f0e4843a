"""Token ids of whole texts from a public byte-level BPE file, with a bounded cache of words, and token attribution."""

from __future__ import annotations

import base64
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import lean

#: Characters on which the two libraries split alike for certain; other texts go through `tokenizers` itself.
_PLAIN = re.compile("[\\t\\n\\r -~¡-ɏ]*")
#: A space beside white space: such texts aren't cut at spaces.
_RUNS = re.compile(r" \s|\s ")
#: Words kept by a worker's cache, and characters whose words are held at once.
CACHE, PART = 200_000, 1_000_000


class Encoder:
    """ids of `tokenizers`' encode(text, add_special_tokens=False), as uint32 arrays.

    A text is cut before each single space, where a byte-level BPE never joins; each word is encoded once in a worker while
    the cache holds it. Texts with other characters than Latin ones, or with runs of white space, or with a special token's
    string, are encoded whole by `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self._whole, self.cache, self.fast = path, None, {}, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        unicode_of, vocab = _byte_letters(), model["model"]["vocab"]
        added = {t["id"]: t["content"] for t in model["added_tokens"]}
        self.byte_len = np.zeros(max([*vocab.values(), *added], default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.byte_len[i] = len(token) if all(c in unicode_of for c in token) else len(token.encode())
        self.special = list(added.values())
        for i, content in added.items():
            self.byte_len[i] = len(content.encode())
        #: ids are stored in so many bytes, by the vocabulary.
        self.kind = "<u2" if len(self.byte_len) <= 1 << 16 else "<u4"
        if ranks and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    @property
    def whole(self):
        """The tokenizer itself, loaded once a text asks for it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Stored ids of " " + word, for many words in one call; their ends are found by the tokens' lengths."""
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), self.kind)
        ends = np.cumsum(self.byte_len[ids])
        stops = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        raw, size = ids.tobytes(), ids.itemsize
        return {w: raw[size * a : size * b] for w, a, b in zip(words, [0, *stops[:-1].tolist()], stops.tolist())}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; words are held for about PART characters at a time."""
        out, at, size = [], 0, 0
        for i, text in enumerate(texts):
            if size and size + len(text or "") > PART:
                out += self._part(texts[at:i])
                at, size = i, 0
            size += len(text or "")
        return out + self._part(texts[at:])

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        cut = {}
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif self.fast and _PLAIN.fullmatch(text) and not any(s in text for s in self.special) and not _RUNS.search(text):
                cut[i] = text.split(" ")
        if cut:
            if len(self.cache) > CACHE:
                self.cache.clear()
            if new := list(set(chain.from_iterable(p[1:] for p in cut.values())).difference(self.cache, ("",))):
                self.cache.update(self._words(new))
            known = self.cache.__getitem__
            for i, parts in cut.items():
                last = parts.pop() if not parts[-1] and len(parts) > 1 else None  # a space at the end is a token of its own
                head = np.array(self.fast.encode_ordinary(parts[0]), self.kind).tobytes() if parts[0] else b""
                tail = np.array(self.fast.encode_ordinary(" "), self.kind).tobytes() if last is not None else b""
                out[i] = np.frombuffer(head + b"".join(map(known, parts[1:])) + tail, self.kind).astype(np.uint32)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.whole.encode_batch([texts[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = np.array(e.ids, np.uint32)
        return out


def _byte_letters() -> set[str]:
    """The 256 letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {chr(b) for b in own} | {chr(0x100 + k) for k in range(256 - len(own))}


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None) -> Encoder:
    """The worker's own, kept between tasks."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def public_paths() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


RULES = ("first", "last", "most")


def attribute_tokens(docs: DataFrame, path: str, ranks: str | None, fields: list[str], rule: str = "first", doc_id: str = "doc_id", separator: str = "\n", section: str = "\n") -> DataFrame:
    """Tokens of each section of each whole document: the document is encoded once and its tokens are dealt to sections.

    A document is its `fields` (nulls: empty) joined by `separator`; a field's sections are its pieces between `section`
    strings, each with the separator that ends it, so sections cover the document without gaps. Each token's character
    span comes from the byte lengths of the ids; spans and sections are joined as intervals, both being in order. A token
    that crosses a boundary goes, by `rule`, to the section of its "first" or "last" character, or to that with "most" of
    its characters (ties: the earlier one); a token that holds part of a character counts with that character. The
    tokens of a document's sections add up to the document's tokens.

    Returns doc_id, field, section (from 0 in its field), start, end (code points in the document, end exclusive),
    n_tokens, n_crossing (of these, tokens that also touch another section) and doc_tokens. Null or empty documents give
    one empty section for each field but for the separators' tokens; repeated rows give repeated rows; an empty table
    gives none; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches):
        enc = encoder(path, ranks)
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            cols = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            texts = [separator.join(x) for x in zip(*cols)]
            for doc, parts, text, ids in zip(batch.column(0).to_pylist(), zip(*cols), texts, enc.encode(texts)):
                names, numbers, lengths = [], [], []
                for k, part in enumerate(parts):
                    pieces = part.split(section)
                    size = [len(p) + len(section) for p in pieces]
                    size[-1] += len(separator) * (k < len(parts) - 1) - len(section)
                    names += [fields[k]] * len(pieces)
                    numbers += range(len(pieces))
                    lengths += size
                edges = np.concatenate([[0], np.cumsum(lengths)])
                got, crossing = _dealt(ids, enc.byte_len, text, edges, rule)
                for column, values in zip(rows, ([doc] * len(names), names, numbers, edges[:-1].tolist(), edges[1:].tolist(), got.tolist(), crossing.tolist(), [len(ids)] * len(names))):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return picked.mapInArrow(lean(run), "doc_id long, field string, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def _dealt(ids: np.ndarray, byte_len: np.ndarray, text: str, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; edges: the sections' bounds in code points."""
    n = len(edges) - 1
    ends = np.cumsum(byte_len[ids]) if len(ids) else np.zeros(0, np.int64)
    starts = ends - byte_len[ids] if len(ids) else ends
    if len(text) != (len(ends) and ends[-1]):  # bytes to code points: a byte belongs to the character that it is part of
        at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
        first, last = (at[starts], at[ends - 1]) if len(ids) else (starts, starts)
    else:
        first, last = starts, ends - 1
    a = np.searchsorted(edges, first, "right") - 1
    b = np.searchsorted(edges, last, "right") - 1
    to = b if rule == "last" else a
    if rule == "most" and len(wide := np.flatnonzero(b > a)):
        to = a.copy()
        for i in wide.tolist():
            k = np.arange(a[i], b[i] + 1)
            to[i] = k[np.argmax(np.minimum(edges[k + 1], last[i] + 1) - np.maximum(edges[k], first[i]))]
    return np.bincount(to, minlength=n), np.bincount(to[b > a], minlength=n)
