"""Byte-level BPE encoding and token counts by offset-mapped attribution.

A document is its fields joined by ``\\n``; it is encoded once as a whole.  In byte-level BPE each token is a slice of
the document's UTF-8, so cumulated token lengths are its offsets.  Token spans are joined to the spans of sections
(each field split at ``\\n``, the break counted to the section it ends) as two sorted interval lists.  A token that
crosses a boundary belongs wholly to the section with its first byte (rule "first"), or with most of its bytes, the
earlier one in a tie ("most"); so the counts of a document's sections always add up to its tokens.

Cases: null fields count as empty and still form one empty section; empty documents give sections with 0 tokens;
repeated rows give repeated results; columns not named as fields are ignored.  A text of any length is encoded whole, in
memory linear in it; of a token half in one section and half in another "most" takes the earlier section.
"""

from __future__ import annotations

import base64
import json
import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_or_empty

SPECIAL = "<|endoftext|>"
#: Fixed value: the published pre-split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, section int, field string, section_start long, section_end long, tokens long, crossing long, doc_tokens long"
_cache = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file: printable bytes for themselves, the others
    for the letters from 256 on, in ascending order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file, .json or .tiktoken, without special tokens."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}


def usual_split(path: str) -> bool:
    """Whether a .json file asks for byte-level splitting by PATTERN, without normalising, and adds no token but SPECIAL."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    split = said.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return plain and said.get("normalizer") is None and {t["content"] for t in said.get("added_tokens", ())} <= {SPECIAL}


def encoder(path: str):
    """text -> list of ids, equal to those of the tokenizers library for the .json file at ``path``.

    The ids come from a faster encoder over the same vocabulary, if the file asks for the pre-split that it knows (see
    usual_split()); a text that holds the special token's string or that this encoder gives up on (endless runs without a
    break) is encoded by the tokenizers library itself, and so are all texts of files that ask for anything else.
    """
    if path not in _cache:
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})

        def exact(text: str) -> list[int]:
            if "exact" not in exact.__dict__:
                from tokenizers import Tokenizer

                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                exact.exact = Tokenizer.from_file(path)
            return exact.exact.encode(text, add_special_tokens=False).ids

        usual = path.endswith(".tiktoken") or usual_split(path)

        def encode(text: str) -> list[int]:
            if SPECIAL in text or not usual:
                return exact(text)
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException" and not isinstance(e, Exception):
                    raise
                return exact(text)

        _cache[path] = encode
    return _cache[path]


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id."""
    if (key := ("bytes", path)) not in _cache:
        table = ranks(path)
        lengths = np.zeros(max(max(table.values()), 50256) + 2, dtype=np.int64)
        for token, i in table.items():
            lengths[i] = len(token)
        lengths[50256] = len(SPECIAL)
        _cache[key] = lengths
    return _cache[key]


def sections_of(fields: list[str]) -> tuple[str, list[tuple[int, int, int]]]:
    """The document and (field, byte start, byte end) of its sections, which cover it without gaps."""
    spans, at = [], 0
    for i, value in enumerate(fields):
        lines = value.split("\n")
        for j, line in enumerate(lines):
            last = i == len(fields) - 1 and j == len(lines) - 1
            end = at + len(line.encode()) + (not last)
            spans.append((i, at, end))
            at = end
    return "\n".join(fields), spans


def attribute(ids: list[int], lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that belong to each section and, of these, those that cross a boundary.  ends: the sections' byte ends."""
    stop = np.cumsum(lengths[np.asarray(ids, dtype=np.int64)])
    start = stop - lengths[np.asarray(ids, dtype=np.int64)]
    if len(ids) and stop[-1] != ends[-1]:
        raise ValueError("token bytes do not cover the document")
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    owner = first.copy()
    if rule == "most":
        for i in np.flatnonzero(first != last):
            bounds = np.concatenate(([start[i]], ends[first[i] : last[i]], [stop[i]]))
            owner[i] = first[i] + int(np.argmax(np.diff(bounds)))
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def _counts(path: str, names: list[str], rule: str):
    def run(batches):
        encode, lengths = encoder(path), token_bytes(path)
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc", "no", "field", "start", "end", "tokens", "crossing", "all")}
            columns = [c.to_pylist() for c in batch.columns]
            for doc, *fields in zip(*columns, strict=True):
                text, spans = sections_of(fields)
                ids = encode(text)
                owned, crossing = attribute(ids, lengths, np.array([e for _, _, e in spans]), rule)
                n = len(spans)
                out["doc"] += [doc] * n
                out["no"] += range(n)
                out["field"] += [names[i] for i, _, _ in spans]
                if text.isascii():
                    out["start"] += [s for _, s, _ in spans]
                    out["end"] += [e for _, _, e in spans]
                else:  # from bytes to code points: leading bytes before each place
                    lead = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)))
                    out["start"] += lead[[s for _, s, _ in spans]].tolist()
                    out["end"] += lead[[e for _, _, e in spans]].tolist()
                out["tokens"] += owned.tolist()
                out["crossing"] += crossing.tolist()
                out["all"] += [len(ids)] * n
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            names_out = ["doc_id", "section", "field", "section_start", "section_end", "tokens", "crossing", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=names_out)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, fields: list[str], rule: str = "first") -> DataFrame:
    """A row for each section: its place in code points, its tokens, those that cross its bounds, the document's tokens."""
    if rule not in ("first", "most"):
        raise ValueError("rule is first or most")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[text_or_empty(f).alias(f"__f{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(_counts(tokenizer_path, fields, rule), SCHEMA)
