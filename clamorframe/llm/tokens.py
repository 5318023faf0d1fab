"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, memoised by word.

The word-BPE file drops white space and never lets a token cross it, so a text's ids are its words'
ids one after the other. A word of plain letters with plain punctuation behind is two pre-tokens, which
go to the library's model directly; every other word goes through the library's whole encoding.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import words

#: Words and word stems whose ids one worker process remembers; what is not remembered is encoded again.
MEMO_WORDS, MEMO_STEMS = 1_500_000, 250_000
#: Text bytes that are encoded together.
SLICE_BYTES = 2 << 20
#: A word in lower case: plain letters with plain punctuation behind, or anything else.
PLAIN = re.compile(r"^(?:([a-zà-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)|(.+))$", re.M)

_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_characters()
        self.stems: dict[str, list[int]] = {}
        #: Sorted hashes of remembered words; of each, where its ids begin in the store and how many there are.
        self.known, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.store = np.zeros(0, np.uint32)

    def _stem(self, text: str) -> list[int]:
        level = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(level)]
        if len(self.stems) < MEMO_STEMS:
            self.stems[text] = ids
        return ids

    def encode_words(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of each word, without white space in it."""
        if not raw:
            return []
        joined = b"\n".join(raw).decode()
        get, stem, out = self.stems.get, self._stem, []
        for (head, tail, other), word in zip(PLAIN.findall(joined.lower()), raw, strict=True):
            if other:
                out.append(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
            elif tail:
                out.append((get(head) or stem(head)) + (get(tail) or stem(tail)))
            else:
                out.append(get(head) or stem(head))
        return out

    def _remember(self, new_hash: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        if len(self.known) + len(new_hash) > MEMO_WORDS:
            return
        order = np.argsort(new_hash)
        begin = len(self.store) + np.cumsum(length) - length
        at = np.searchsorted(self.known, new_hash[order])
        self.known = np.insert(self.known, at, new_hash[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.length = np.insert(self.length, at, length[order])
        self.store = np.concatenate([self.store, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and where each text's ids begin (one entry more than texts)."""
        starts, ends, first = words.bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = words.as_array(data, starts, ends).dictionary_encode()
        vocabulary = coded.dictionary
        letters, edges = common_bytes(vocabulary)
        key = words.hashes(letters, edges[:-1], edges[1:])
        at = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
        seen = self.known[at] == key if len(self.known) else np.zeros(len(key), bool)
        fresh = np.flatnonzero(~seen)
        coded_fresh = self.encode_words(vocabulary.take(pa.array(fresh)).to_pylist())
        fresh_length = np.fromiter(map(len, coded_fresh), np.int32, len(coded_fresh))
        fresh_ids = np.fromiter(chain.from_iterable(coded_fresh), np.uint32, int(fresh_length.sum()))
        begin, length = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        begin[seen], length[seen] = self.begin[at[seen]], self.length[at[seen]]
        begin[fresh] = len(self.store) + np.cumsum(fresh_length) - fresh_length
        length[fresh] = fresh_length
        both = np.concatenate([self.store, fresh_ids])
        edges = np.zeros(len(key) + 1, np.int32)
        np.cumsum(length, out=edges[1:])
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(both[words.ranges(begin, length.astype(np.int64))]))
        taken = lists.take(coded.indices)
        ids, upto = taken.values.to_numpy(), taken.offsets.to_numpy()
        self._remember(key[fresh], fresh_length, fresh_ids)
        return ids, upto.astype(np.int64)[first]


def common_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offset_buffer, data_buffer = column.buffers()
    edges = np.frombuffer(offset_buffer, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8)[edges[0] : edges[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]
