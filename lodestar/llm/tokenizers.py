"""Public vocabularies from files; loaded once a Python worker, never trained."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER_DIR = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are cut before a blank between two non-spaces, where neither kind of tokenizer merges, and by force in a longer run without one.
BLOCK = 20_000


def blocks(text: str, size: int = BLOCK) -> list[str]:
    if len(text) <= size:
        return [text]
    out, at = [], 0
    edge = re.compile(r"(?<=\S)(?= \S)")
    while len(text) - at > size:
        m = edge.search(text, at + size, at + 2 * size)
        to = m.start() if m else at + size
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


@cache
def ranks(folder: str, name: str = "byte_bpe_50k"):
    import tiktoken

    with open(Path(folder, f"{name}.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lodestar_" + name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@cache
def pieces(folder: str, name: str = "piece_bpe_32k"):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, f"{name}.model")))


@cache
def byte_pieces(folder: str, name: str = "piece_bpe_32k") -> frozenset[int]:
    p = pieces(folder, name)
    return frozenset(i for i in range(p.get_piece_size()) if p.is_byte(i))


def encode_ranks(folder: str, text: str) -> list[int]:
    e = ranks(folder)
    if len(text) <= BLOCK:
        return e.encode_ordinary(text)
    return [i for b in blocks(text) for i in e.encode_ordinary(b)]


def encode_pieces(folder: str, text: str) -> list[int]:
    p = pieces(folder)
    if len(text) <= BLOCK:
        return p.encode(text, num_threads=1)
    # each block is given a blank in front, as the text is; the one it was cut before goes
    first, *rest = blocks(text)
    return [*p.encode(first, num_threads=1), *(i for b in rest for i in p.encode(b.removeprefix(" "), num_threads=1))]


#: Texts with other white space than single blanks and line ends within, or the sign that stands for a blank in the pieces.
_ODD = r"  | \n|\n |^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{2581}\x{3000}]"
#: Bytes of text whose words are encoded together.
TOGETHER = 4 << 20


@cache
def _after_blank(folder: str) -> np.ndarray:
    """Whether each id of the ranks begins with a blank."""
    e = ranks(folder)
    return np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(e.n_vocab)])


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint16, int(size.sum())), size


@dataclass
class Encoded:
    """Texts as places in a list of entries, of the sizes given, whose ids stand one after the other."""

    entries: np.ndarray
    size: np.ndarray
    at: np.ndarray
    first: np.ndarray

    @property
    def edge(self) -> np.ndarray:
        """Where each text's ids begin, and the last ones end."""
        return np.append(0, np.cumsum(self.size[self.at], dtype=np.int64))[self.first]

    @property
    def ids(self) -> np.ndarray:
        """The ids of all texts, one after the other."""
        begin, own = (np.cumsum(self.size) - self.size)[self.at].astype(np.int32), self.size[self.at].astype(np.int32)
        begin[1:] -= np.cumsum(own, dtype=np.int32)[:-1]
        where = np.repeat(begin, own)
        where += np.arange(len(where), dtype=np.int32)
        return self.entries[where]


def encode_all(folder: str, texts: pa.Array, both: bool = False) -> list[Encoded]:
    """encode_ranks() of all texts; if both, then encode_pieces() of them too.

    No kind of tokenizer merges over a blank between two non-spaces, so texts are cut there and
    each different word is encoded once.  Texts with other white space are encoded whole."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(pc.binary_length(texts).to_numpy() > BLOCK):
        # blocks() cuts within words so long
        odd[i] = odd[i] or max(map(len, texts[i].as_py().split(" "))) > BLOCK // 2
    cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    first = cut.offsets.to_numpy()
    coded = cut.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy().copy(), coded.dictionary
    whole = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(odd)}
    # a word in a text has a blank before it, the first has none; the empty word stands for an empty or odd text only
    own, some = ranks(folder).encode_ordinary, pc.binary_length(words).to_numpy() > 0
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, int(some.sum())], pa.int32()), words.filter(pa.array(some))), " ")[0].as_py()
    ids = np.array(own(" " + joined) if joined else [], np.uint16)
    size = np.zeros(len(words), np.int64)
    size[some] = np.diff(np.append(np.flatnonzero(_after_blank(folder)[ids]), len(ids)))
    heads, lengths = _flat([encode_ranks(folder, whole[i]) if i in whole else own(w) for i, w in enumerate(words.take(pa.array(at[first[:-1]])).to_pylist())])
    place = at.copy()
    place[first[:-1]] = len(words) + np.arange(len(texts))
    out = [Encoded(np.append(ids, heads), np.append(size, lengths), place, first)]
    if both:
        # cut in Python, which is faster than a list from Arrow
        ids, lengths = _flat(pieces(folder).encode(joined.split(" "), num_threads=1) if joined else [])
        size = np.zeros(len(words), np.int64)
        size[some] = lengths
        rest, lengths = _flat([encode_pieces(folder, t) for t in whole.values()])
        at[first[:-1][odd]] = len(words) + np.arange(len(whole))
        out.append(Encoded(np.append(ids, rest), np.append(size, lengths), at, first))
    return out


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of about TOGETHER bytes, or a single one that is longer."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + TOGETHER, side="right")) - 1)
        yield texts.slice(a, z - a)
        a = z
