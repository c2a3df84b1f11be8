"""Encoding of whole texts with a public byte-level BPE tokenizer, and cutting them into bounded pieces.

Forced boundaries: a pair of bytes that stands in no vocabulary token can never lie inside an output token, so
byte-pair merging on its two sides is independent.  Every text is cut at such pairs, the distinct fragments of a
batch are encoded once each, and their ids are put together again by numpy.  Two kinds of forced pairs are not
used, because the pre-tokenizer looks across them: those after white space (a run of white space is split
according to what follows it) and those before an apostrophe (contractions).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.session import ensure_importable

#: Where the vocabulary files lie; a parameter of every operator here.
DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Fragments kept per worker between batches.
CACHE = 400_000

# Last bytes of the UTF-8 forms of white space (and of the ASCII separators 1C-1F).
_SPACE_END = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]


def tokenizer_dir() -> str:
    """The folder of the installed public vocabularies; QUERN_TOKENIZERS names another one."""
    named = os.environ.get("QUERN_TOKENIZERS")
    if named:
        return named
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ModuleNotFoundError:
        return "/opt/tokenizers"


class Encoder:
    """A byte-level BPE vocabulary with its forced boundaries."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        self.forced = ~inside
        self.forced[_SPACE_END, :] = False
        self.forced[:, ord("'")] = False
        self.forced[:, 0x80:0xC0] = False  # never inside a character
        self.width = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.known: dict[bytes, list[int]] = {}

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets by text).  Null and empty texts have no ids."""
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        text = pa.concat_arrays([text])
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        base, end = int(offsets[0]), int(offsets[-1])
        if base == end:
            return np.zeros(0, np.int32), np.zeros(len(text) + 1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8, end - base, base)
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = self.forced[data[:-1], data[1:]]
        begins[offsets - base] = True
        at = np.flatnonzero(begins)
        cuts = pa.py_buffer(at.astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        code = np.asarray(coded.indices)
        encode, known = self.bpe.encode_ordinary, self.known
        if len(known) > CACHE:
            known.clear()
        ids: list[list[int]] = []
        for piece in coded.dictionary.to_pylist():
            got = known.get(piece)
            if got is None:
                got = encode(piece.decode("utf-8"))
                if len(piece) <= 40:
                    known[piece] = got
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - start[code], n)]
        return out, upto[np.searchsorted(at, offsets - base)]


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> Encoder:
    """The encoder of a vocabulary, loaded once per worker."""
    return Encoder(os.path.join(folder or tokenizer_dir(), f"{name}.tiktoken"), _pattern(folder))


def _pattern(folder: str | None) -> str:
    import importlib.util

    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder or tokenizer_dir(), "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text, one row for every row of ``docs``.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text; repeated
    rows give repeated rows.  Further columns are ignored.
    """
    ensure_importable(docs.sparkSession)
    folder = folder or tokenizer_dir()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            ids, offsets = enc.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


# Natural boundaries from the best to the poorest, as patterns on the bytes before a cut.
BOUNDARIES = [
    rb"\n[ \t\r]*\n\s*",
    rb"\n",
    rb"(?:[.!?](?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)",
    rb"(?:[;:,](?=\s)|\xef\xbc\x8c|\xef\xbc\x9b)",
    rb"\S(?=\s)",
]


def _boundaries(raw: bytes, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of boundary the ascending numbers of tokens after which it stands.  ends: byte ends of the tokens."""
    import re

    out = []
    for pattern in BOUNDARIES:
        at = np.fromiter((m.end() for m in re.finditer(pattern, raw)), np.int64)
        tok = np.searchsorted(ends, at)
        hit = ends[np.minimum(tok, len(ends) - 1)] == at
        out.append(tok[hit] + 1)
    return out


def cut_points(raw: bytes, widths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, end token) of each piece of a text with tokens of these byte widths.

    Byte ends are the prefix sums of the widths.  The end of a piece is the last boundary under the limit, found
    by binary search in the sorted array of the best kind that has one in the later half of the window; where no
    kind has one there, in what is left of the window after the overlap; where none has one there either, the cut is hard.  No piece begins or ends inside a character.
    """
    n = len(widths)
    if n <= limit:
        return [(0, n)]
    ends = np.cumsum(widths)
    data = np.frombuffer(raw, np.uint8)
    whole = np.ones(n + 1, bool)  # a character begins after so many tokens
    whole[1:-1] = (data[ends[:-1]] & 0xC0) != 0x80
    kinds = _boundaries(raw, ends)

    def last_natural(low: int, high: int) -> int:
        """The last boundary of the best kind that has one from ``low`` to ``high``, else 0."""
        for at in kinds:
            k = np.searchsorted(at, high, side="right") - 1
            while k >= 0 and at[k] >= low:
                if whole[at[k]] and whole[at[k] - overlap]:
                    return int(at[k])
                k -= 1
        return 0

    pieces, start = [], 0
    while True:
        if start + limit >= n:
            pieces.append((start, n))
            return pieces
        low, high = start + max(overlap + 1, limit // 2), start + limit
        end = last_natural(low, high) or last_natural(start + overlap + 1, low - 1)
        if not end:
            fit = [e for e in range(high, start + overlap, -1) if whole[e] and whole[e - overlap]]
            end = fit[0] if fit else high
        pieces.append((start, end))
        start = end - overlap


def split_oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 768, overlap: int = 64, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, piece, first_token, end_token, n_tokens, piece_text) of every text of more than ``limit`` tokens.

    Pieces count from 0, hold at most ``limit`` tokens of the whole text's encoding and begin with the last
    ``overlap`` tokens of the piece before.  Null, empty and short texts give no rows; repeated rows give repeated
    pieces; further columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half of the limit")
    ensure_importable(docs.sparkSession)
    folder = folder or tokenizer_dir()
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            ids, offsets = enc.encode(batch.column(1))
            rows: list[tuple[int, int, int, int, str]] = []
            for i in np.flatnonzero(np.diff(offsets) > limit):
                raw = batch.column(1)[int(i)].as_py().encode()
                widths = enc.width[ids[offsets[i] : offsets[i + 1]]]
                upto = np.concatenate([[0], np.cumsum(widths)])
                for p, (a, b) in enumerate(cut_points(raw, widths, limit, overlap)):
                    rows.append((int(i), p, a, b, raw[upto[a] : upto[b]].decode("utf-8", "replace")))
            take = pa.array([r[0] for r in rows], pa.int64())
            a, b = (pa.array([r[j] for r in rows], pa.int32()) for j in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array([r[1] for r in rows], pa.int32()), a, b, pc.subtract(b, a), pa.array([r[4] for r in rows], pa.string())],
                names=[key, "piece", "first_token", "end_token", "n_tokens", "piece_text"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, first_token int, end_token int, n_tokens int, piece_text string")
