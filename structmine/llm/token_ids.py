"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The pre-tokenizer of these files cuts texts into runs of letters, of digits and of other characters, each
with at most one space before it, and white space; tokens never reach over its cuts.  Some of the cuts
show from the bytes alone: before a space or line feed that follows a character other than white space,
behind a line feed between two such characters, and between an ASCII letter and a mark such as a comma.
Texts are cut there, and the library encodes each distinct part of a slice once, many side by side.  A text
that holds a special token's string is encoded as a whole.

Parts are told apart by their bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from structmine.llm import spans

#: Parts that are encoded as one text.
TOGETHER = 256
#: Bytes of texts whose parts are told apart at a time: the more, the fewer distinct parts a byte of text has.
AT_ONCE = 8 * spans.SLICE_BYTES

_BLANK = ~spans.NOT_SPACE
_BLANK[[28, 29, 30, 31]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: White space beyond ASCII, as UTF-8.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_STARTS = sorted({c[:2] for c in _WIDE_BLANKS})


def _blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    blank = _BLANK[data]
    if (data >= 0x80).any():
        raw = data.tobytes()
        for character in _WIDE_BLANKS if any(x[:1] in raw and x in raw for x in _WIDE_STARTS) else ():
            at = raw.find(character)
            while at >= 0:
                blank[at : at + len(character)] = True
                at = raw.find(character, at + 1)
    return blank


def parts(found: spans.Texts) -> spans.Spans:
    """Parts of texts that can be encoded apart, in order; an empty text has none."""
    data = found.data
    blank = _blanks(data)
    cut = np.zeros(len(data), bool)
    cut[1:] = ~blank[:-1] & ((data[1:] == 32) | (data[1:] == 10))
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[2:] |= ~blank[:-2] & (data[1:-1] == 10) & ~blank[2:]
    # near a text's start the rules above looked into the text before
    first = found.offsets[:-1][found.offsets[:-1] < found.offsets[1:]]
    second = first[first + 1 < len(data)] + 1
    cut[second] = _one_back(data, blank, second)
    cut[first] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data)) if len(start) else start
    return spans.Spans(start, end, np.searchsorted(found.offsets, start, side="right") - 1)


def _one_back(data: np.ndarray, blank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rules that look at one byte before the cut only."""
    return (~blank[at - 1] & ((data[at] == 32) | (data[at] == 10))) | (_LETTER[data[at - 1]] & _MARK[data[at]])


class Encoder:
    """Not picklable: one per Python worker, see ``encoder``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._special = [t.content.encode() for t in self._library.get_added_tokens_decoder().values()]
        # a byte-level token is written with one character a byte; a special one stands in no part
        vocabulary = self._library.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(self._library.get_vocab(with_added_tokens=True).values(), default=0) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._break = self._library.encode("\n", add_special_tokens=False).ids

    def encode(self, found: spans.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's ids begin and end (one more than texts)."""
        raw = found.data.tobytes()
        if any(s in raw for s in self._special):
            return self._one_by_one(found, raw)
        start = parts(found).start
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(found.rows + 1, np.int64)
        # one part ends where the next begins, so their places are an Arrow column's offsets
        ends = np.append(start, len(raw))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        lists, place = self._encoded(coded.dictionary)
        taken = lists.take(pa.array(place[coded.indices.to_numpy(zero_copy_only=False)]))
        at = np.searchsorted(start, found.offsets)
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[at]

    def _one_by_one(self, found: spans.Texts, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = found.offsets.tolist()
        ids = self._whole([raw[a:b].decode() for a, b in zip(at, at[1:])])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0] + [len(x) for x in ids])

    def _encoded(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of the parts' ids in an order of their own, and each part's place there."""
        own = spans.texts(distinct.view(pa.large_string()))
        blanks = spans.per_row(_blanks(own.data), own.offsets)
        # white space inside a part, but for one space in front, needs the part alone
        spaced = (own.data[own.offsets[:-1]] == 32) & (blanks == 1) & (np.diff(own.offsets) > 1)
        found, sure = self._side_by_side(distinct, np.flatnonzero(spaced))
        spaced = np.zeros(len(distinct), bool)
        spaced[sure] = True
        joined, alone = np.flatnonzero((blanks == 0) & ~spaced), np.flatnonzero((blanks > 0) & ~spaced)
        texts = lambda which: [x.decode() for x in distinct.take(pa.array(which)).to_pylist()]
        words = texts(joined)
        lists = [_lists([x for i in range(0, len(words), TOGETHER) for x in self._as_lines(words[i : i + TOGETHER])])]
        lists.append(_lists(self._whole(texts(alone))))
        place = np.empty(len(distinct), np.int32)
        place[np.concatenate([sure, joined, alone])] = np.arange(len(distinct))
        return pa.concat_arrays([found, *lists]), place

    def _side_by_side(self, distinct: pa.Array, which: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Encodes parts with a space in front behind each other, where every part begins a token; the tokens' bytes
        tell which.  Gives the lists of ids and the parts they belong to: those of texts whose tokens end with the parts."""
        own = spans.texts(distinct.take(pa.array(which)).view(pa.large_string()))
        raw, limits = own.data.tobytes(), own.offsets[1:]
        cuts = np.unique(np.append(own.offsets[:-1:TOGETHER], len(raw)))
        ids = self._whole([raw[a:b].decode() for a, b in zip(cuts.tolist(), cuts[1:].tolist())])
        values = np.concatenate([np.zeros(0, np.uint32), *ids])
        reached = np.cumsum(self._bytes[values])
        text_ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        if len(which) == 0 or (reached[text_ends - 1] != cuts[1:]).any():
            return _lists([]), np.zeros(0, np.int64)
        last = np.searchsorted(reached, limits)
        missed = np.bincount(np.arange(len(which)) // TOGETHER, weights=reached[last] != limits)
        sure = np.repeat(missed == 0, TOGETHER)[: len(which)]
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, last + 1)), pa.array(values))
        return lists.filter(pa.array(sure)), which[sure]

    def _as_lines(self, group: list[str]) -> list[np.ndarray]:
        """Encodes parts as lines of one text; a line feed is a token of its own there."""
        ids = self._whole(["\n".join(group)])[0]
        breaks = np.flatnonzero(ids == self._break[0]) if len(self._break) == 1 else []
        if len(breaks) != len(group) - 1:
            return self._whole(group)
        return [ids[a:b] for a, b in zip([0, *(breaks + 1).tolist()], [*breaks.tolist(), len(ids)])]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4") for e in found]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind every text's ids."""
    rows = len(ends) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    later = ends + np.arange(rows + 1)
    keep[later[1:] - 1] = False
    out[keep] = ids
    return out, later
