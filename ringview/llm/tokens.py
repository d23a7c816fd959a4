"""Token ids of whole texts with the tokenizers library, one call per distinct chunk.

The byte-level pattern of a byte-level BPE makes no piece that goes on from a character that is not white space to white space,
or from a letter to a mark, and looks at nothing before a piece. So texts are cut at these places, the chunks between them are
encoded once and kept, and the ids of a text are those of its chunks; the library itself splits and merges within each
chunk. Texts that hold an added token are encoded whole. Chunks are found by a hash of their bytes for a batch of texts at once, and compared
byte by byte with what was kept, so that a hash that two chunks share changes no result.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Chunks kept by a worker; beyond it the half that was met last stays, which only costs time.
MAX_KEPT = 1_500_000
#: Longer chunks, in bytes, are encoded each time: texts without spaces would fill the memory.
MAX_CHUNK = 64
#: Characters of texts that are cut at once; a longer text is taken in parts of about as many.
MAX_TEXT = 500_000

#: Words of letters that every Unicode version knows go to the library's model directly.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: A place where a long text may be parted.
_PART = re.compile("(?<=[!-~])[ \n]")
_ENCODERS: dict[str, Encoder] = {}


def _bytes_of(text: str) -> np.ndarray:
    """For each byte, whether it is one of these."""
    return np.isin(np.arange(256), list(text.encode("latin-1")))


_CUT, _SPACE = _bytes_of(" \n"), _bytes_of("\t\n\v\f\r\x1c\x1d\x1e\x1f ")
_MARK = _bytes_of("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LETTER = _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: First bytes of the letters U+00C0 to U+023F, and last bytes of white space beyond ASCII (and of some other characters).
_LEADS, _TAILS = _bytes_of("\xc3\xc4\xc5\xc6\xc7\xc8"), _bytes_of("\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8e\x9f\xa0\xa8\xa9\xaf")
_SPACE_LEADS = _bytes_of("\xe1\xe2\xe3")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _starts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut: before white space that follows none, and before a mark behind a letter."""
    before, two, three = (np.concatenate([np.zeros(k, np.uint8), data[: max(len(data) - k, 0)]])[: len(data)] for k in (1, 2, 3))
    at = np.flatnonzero(_CUT[data])
    b, c, d = before[at], two[at], three[at]
    wide = _TAILS[b] & ((c == 0xC2) | _SPACE_LEADS[d])
    spaces = at[~(_SPACE[b] | wide)]
    at = np.flatnonzero(_MARK[data])
    b, c = before[at], two[at]
    signs = (c == 0xC3) & ((b == 0x97) | (b == 0xB7))
    marks = at[_LETTER[b] | ((b >= 0x80) & _LEADS[c] & ~signs)]
    return np.concatenate([spaces, marks])


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...`` of each length, one after another."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def _parts(text: str) -> list[str]:
    """A text in parts whose ids do not depend on each other."""
    cuts = [0]
    while len(text) - cuts[-1] > MAX_TEXT and (found := _PART.search(text, cuts[-1] + MAX_TEXT)):
        cuts.append(found.start())
    return [text] if len(cuts) == 1 else [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class _Flat:
    """Runs of numbers, one after another."""

    def __init__(self, kind: type) -> None:
        self.data, self.first, self.length, self.count, self.used = np.empty(1024, kind), np.empty(1024, np.int64), np.empty(1024, np.int64), 0, 0

    def add(self, values: np.ndarray, length: np.ndarray) -> None:
        if (need := self.used + len(values)) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.empty(need, self.data.dtype)])
        if (need := self.count + len(length)) > len(self.first):
            self.first, self.length = (np.concatenate([x[: self.count], np.empty(need, np.int64)]) for x in (self.first, self.length))
        self.data[self.used : self.used + len(values)] = values
        self.first[self.count : self.count + len(length)] = self.used + np.cumsum(length) - length
        self.length[self.count : self.count + len(length)] = length
        self.used, self.count = self.used + len(values), self.count + len(length)

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.data[_runs(self.first[at], self.length[at])]

    def cut(self, count: int) -> None:
        """Forget all runs from this one on."""
        if count < self.count:
            self.used, self.count = int(self.first[count]), count

    def keep(self, at: np.ndarray) -> _Flat:
        out = _Flat(self.data.dtype)
        out.add(self.take(at), self.length[at])
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._factors = np.random.default_rng(7).integers(1, 2**64, MAX_CHUNK + 1, np.uint64)
        # Hashes in ascending order and the number of each one's chunk; by number: bytes, ids and the batch that met it last.
        self._hashes, self._numbers, self._met = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._bytes, self._ids, self._batch = _Flat(np.uint8), _Flat(np.uint32), 0
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 in order.
        others = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
        self._letters = {b: chr(256 + k) for k, b in enumerate(others)}

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's encoder of this vocabulary file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        own, parts, size = [], [], 0
        for k, t in enumerate(texts):
            if any(x in t for x in self._added):
                out[k] = self._encode_whole([t])[0]
                continue
            for part in _parts(t):
                if size + len(part) > MAX_TEXT and parts:
                    self._add(out, own, parts)
                    own, parts, size = [], [], 0
                own.append(k)
                parts.append(part)
                size += len(part)
        self._add(out, own, parts)
        return out

    def _add(self, out: list[bytes], own: list[int], parts: list[str]) -> None:
        """Put the ids of each part behind those of its text."""
        found = self._encode_cut([x.encode() for x in parts])
        for k, ids in zip(own, self._encode_whole(parts) if found is None else found, strict=True):
            out[k] = out[k] + ids if out[k] else ids

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self._encode(texts)]

    def _encode_cut(self, raw: list[bytes]) -> list[bytes] | None:
        """The ids of texts by their chunks; none if two chunks share a hash."""
        text = b"".join(raw)
        if not text:
            return [b""] * len(raw)
        data, ends = np.frombuffer(text, np.uint8), np.cumsum([len(x) for x in raw])
        begin = np.zeros(len(data), bool)
        begin[_starts(data)] = True
        begin[0] = True
        begin[ends[ends < len(data)]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(starts, append=len(data))
        place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), MAX_CHUNK)
        hashes = np.add.reduceat(self._factors[place] * (data.astype(np.uint64) + np.uint64(1)), starts)

        short = np.flatnonzero(lengths <= MAX_CHUNK)
        distinct, sample, which = np.unique(hashes[short], return_index=True, return_inverse=True)
        sample = short[sample]
        at = np.searchsorted(self._hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self._hashes)
        known[inside] = self._hashes[at[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int64)
        number[known] = self._numbers[at[known]]
        count = self._ids.count
        number[~known] = count + np.arange(int((~known).sum()))
        self._batch += 1
        self._learn(text, data, starts[sample[~known]], lengths[sample[~known]])
        self._hashes, self._numbers = np.insert(self._hashes, at[~known], distinct[~known]), np.insert(self._numbers, at[~known], number[~known])
        self._met = np.concatenate([self._met, np.empty(self._ids.count - count, np.int64)])
        self._met[number] = self._batch
        kept = self._ids.count
        long = np.flatnonzero(lengths > MAX_CHUNK)
        self._learn(text, data, starts[long], lengths[long])

        numbers = np.empty(len(starts), np.int64)
        numbers[short], numbers[long] = number[which], kept + np.arange(len(long))
        same = np.array_equal(self._bytes.length[numbers], lengths) and np.array_equal(self._bytes.take(numbers), data)
        ids = self._ids.take(numbers).astype("<u4").tobytes() if same else b""
        tokens = np.concatenate([[0], np.cumsum(self._ids.length[numbers])])
        self._bytes.cut(kept)
        self._ids.cut(kept)
        if kept > MAX_KEPT:
            self._forget()
        if not same:
            return None
        bounds = [0, *(4 * tokens[np.searchsorted(starts, ends)]).tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, text: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Add the bytes and ids of these chunks."""
        if not len(starts):
            return
        tokenize, letters, space = self._model.tokenize, self._letters, self._letters[32]
        ids: list[list[int]] = []
        others = []
        for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            chunk = text[a : a + n].decode()
            if not _WORD.fullmatch(chunk):
                others.append((len(ids), chunk))
                ids.append([])
                continue
            word = chunk.replace(" ", space) if chunk.isascii() else chunk.encode().decode("latin-1").translate(letters)
            ids.append([t.id for t in tokenize(word)])
        for (k, _), found in zip(others, self._encode([x for _, x in others]), strict=True):
            ids[k] = found
        self._bytes.add(data[_runs(starts, lengths)], lengths)
        self._ids.add(np.array([x for own in ids for x in own], np.uint32), np.array([len(x) for x in ids]))

    def _forget(self) -> None:
        """Keep the half of the chunks that was met last."""
        keep = np.sort(np.argpartition(-self._met, MAX_KEPT // 2)[: MAX_KEPT // 2])
        new = np.full(len(self._met), -1)
        new[keep] = np.arange(len(keep))
        stays = new[self._numbers] >= 0
        self._hashes, self._numbers = self._hashes[stays], new[self._numbers[stays]]
        self._met, self._bytes, self._ids = self._met[keep], self._bytes.keep(keep), self._ids.keep(keep)
