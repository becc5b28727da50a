"""Token ids of the distinct words of a batch, and how they are put together again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from tokenizers import Tokenizer


def load_tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for.

    Printable Latin-1 characters stand for themselves, the other bytes take the code points
    from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of single words, as packed unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self._tokenize = self.tokenizer.model.tokenize
        self._letters = {b: c for c, b in byte_values().items()}

    def merged(self, word: str) -> bytes:
        """Ids of a word that the tokenizer's pre-tokenizer leaves whole: its merges alone."""
        shown = word.encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._tokenize(shown)], "<u4").tobytes()

    def encoded(self, words: list[str]) -> list[bytes]:
        """Ids of any texts."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def ragged(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of packed lists in one array, and the length of each list."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    return np.frombuffer(b"".join(lists), "<u4"), sizes


def gather(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The items of the lists `codes`, one list after the other."""
    size = sizes[codes]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, items.dtype)
    return items[np.repeat(starts[codes] - (ends - size), size) + np.arange(ends[-1])]


def ranges(sizes: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `limit` each."""
    size = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    return [(int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(size)), strict=True)]


def slices(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each."""
    return ranges(pc.binary_length(texts), limit)


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """Words as packed lengths and compressed text; sorted words compress best."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return pack(sizes), zstandard.ZstdCompressor(level=3).compress("".join(words).encode())


def unpack_words(sizes: bytes, text: bytes) -> list[str]:
    whole = zstandard.ZstdDecompressor().decompress(text).decode()
    ends = np.cumsum(unpack(sizes).astype(np.int64)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
