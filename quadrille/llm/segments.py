"""Cuts text where byte-level BPE can be cut, so that equal pieces are encoded once.

The pattern of the public byte-level vocabularies never matches across a blank (U+0020) that has a
character other than white space on both sides: such a blank always opens a new match.  Texts whose
blanks all stand so are joined from the encodings of their pieces; others are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's cache before it is cut to those found again.
CACHE_ENTRIES = 700_000
#: Bytes of a batch: the larger, the fewer distinct pieces a byte.
BATCH_BYTES = 8 << 20
#: Marks that often end a word.
TAILS = ".,;:!?"


class BoundedCache(dict):
    """Encodings by text, none of them empty.  When full it keeps what later blocks have found in it
    again (looked at in every fourth block)."""

    def __init__(self, most: int = CACHE_ENTRIES):
        super().__init__()
        self.most, self.again, self.blocks = most, set(), 0

    def lookup(self, wanted: list[str]) -> tuple[list[bytes | None], list[str]]:
        """What is known of some distinct texts, and which have to be encoded; makes room for them."""
        found = list(map(self.get, wanted))
        new = list(compress(wanted, map(not_, found)))
        if self.blocks % 4 == 0 or len(self) + len(new) > self.most:
            self.again.update(compress(wanted, found))
        self.blocks += 1
        if len(self) + len(new) > self.most:
            keep = self.again if len(self.again) < self.most // 2 else list(compress(wanted, found))
            kept = {p: self[p] for p in keep}
            self.clear()
            self.update(kept)
            self.again = set()
        return found, new


class PieceCache:
    """Encodings of pieces that follow a blank; bounded, frequent pieces stay.

    ``encode_after_blank`` gets pieces without their blank; none is empty, holds a blank, or begins
    or ends with white space.  ``encode`` gets any text.  Encodings are little-endian unsigned 32-bit
    integers.  With ``cut_tails`` the pattern parts letters from one mark after them, so a word and
    the word with a full stop are encoded once.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[bytes]],
        encode_after_blank: Callable[[list[str]], list[bytes]],
        cut_tails: bool = False,
        most: int = CACHE_ENTRIES,
    ):
        self.encode, self.encode_after_blank = encode, encode_after_blank
        self.after_blank = BoundedCache(most)
        self.tails = dict(zip(TAILS, encode(list(TAILS)), strict=True)) if cut_tails else {}

    def _values(self, pieces: list[str]) -> list[bytes]:
        """Encodings of distinct pieces."""
        cache, tails = self.after_blank, self.tails
        found, new = cache.lookup(pieces)
        tailed = [p for p in new if p[-1] in tails and p[:-1].isalpha()]
        words = {p[:-1] for p in tailed}
        wanted = list(words.difference(cache).union(set(new).difference(tailed)))
        fresh = dict(zip(wanted, self.encode_after_blank(wanted), strict=True))
        known = cache.get
        for p in tailed:
            fresh[p] = (fresh.get(p[:-1]) or known(p[:-1])) + tails[p[-1]]
        cache.update(fresh)
        return [v or fresh[p] for p, v in zip(pieces, found, strict=True)]

    def encode_array(self, texts: pa.Array, whole: Sequence[str] | None = ()) -> list[bytes]:
        """Encoded ids of each text; null counts as empty.

        Texts that hold a string of ``whole`` are never cut; None stands for all of them.  Pieces are
        cut and made distinct by Arrow; only distinct ones come to Python.
        """
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if whole is None:
            return self.encode(texts.to_pylist())
        lists = pc.split_pattern(texts, pattern=" ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        distinct = coded.dictionary
        pieces = distinct.to_numpy(zero_copy_only=False).tolist()
        heads = offsets[:-1]
        inner = np.ones(len(at), bool)
        inner[heads] = False
        # Only pieces that follow a blank somewhere are wanted, and none that white space touches.
        used = np.zeros(len(pieces), bool)
        used[at[inner]] = True
        size = pc.binary_length(distinct).to_numpy()
        odd = (size == 0) | (pc.binary_length(pc.utf8_trim_whitespace(distinct)).to_numpy() < size)
        # Pieces that are not wanted get the empty encoding, by a number of their own.
        wanted = used & ~odd
        place = np.where(wanted, np.cumsum(wanted) - 1, 0).astype(np.int32)
        values = self._values(pieces if wanted.all() else list(compress(pieces, wanted.tolist())))
        # A text with an odd piece after a blank, or a head that ends in white space, is encoded whole.
        counts = np.diff(offsets)
        uncut = (counts > 1) & (pc.binary_length(pc.utf8_rtrim_whitespace(distinct)).to_numpy() < size)[at[heads]]
        if odd.any():
            doc = np.repeat(np.arange(n), counts)
            uncut[doc[inner & odd[at]]] = True
        for w in whole:
            uncut |= pc.match_substring(texts, w).to_numpy(zero_copy_only=False)
        first = [texts[i].as_py() if u else pieces[k] for i, (u, k) in enumerate(zip(uncut.tolist(), at[heads].tolist(), strict=True))]
        starts = list(set(first))
        number = {p: len(values) + 1 + k for k, p in enumerate(starts)}
        empty = len(values)
        values += [b"", *self.encode(starts)]
        at = place[at]
        if uncut.any():
            at[np.repeat(uncut, counts)] = empty
        at[heads] = [number[p] for p in first]
        lengths = (np.fromiter(map(len, values), np.int32, len(values)) // 4).astype(np.int32)
        flat = np.frombuffer(b"".join(values), "<u4")
        begin = (np.cumsum(lengths) - lengths).astype(np.int32)
        own = lengths[at]
        ends = np.cumsum(own, dtype=np.int32)
        ids = flat[np.repeat(begin[at] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        cut = (4 * np.concatenate([[0], ends.astype(np.int64)])[offsets]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
