"""Token ids of whole texts with a public tokenizer file.

The tokenizer's rules never look across ASCII white space, so a text's ids are the ids of its words in order. Arrow cuts the texts of a
slice into words and finds the distinct ones; their pieces are cut in one go, and the ids of each word are put in its places.
Pieces repeat over slices, so their ids are kept in the worker; the stores are emptied when full, which bounds their memory. The library's own
normalizer, splitter and model do the work for each new piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from talentweave.llm.common import worker_cache

END_ID = 2
WORDS_KEPT, PIECES_KEPT = 300_000, 900_000
#: Bytes of texts that are cut into words at a time.
SLICE_BYTES = 1 << 23
#: Words of ASCII and the letters of Latin-1, which need no other normalizing than lower case, and how the tokenizer
#: splits them (a line break ends a word). Other words go through its own normalizer and splitter.
PLAIN_WORDS = "^[!-~À-ÖØ-öø-ÿ]*$"
PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
LETTERS = [chr(c) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at a time: ``SLICE_BYTES`` of the column, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


class Encoder:
    """Ids are unsigned 16-bit integers; those of a text are followed by the end id."""

    def __init__(self, path: str, end_id: int | None = END_ID):
        held = worker_cache(f"tokens {path}")
        if not held:
            tokenizer = Tokenizer.from_file(path)
            special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
            as_bytes = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}
            held.update(
                tokenizer=tokenizer, model=tokenizer.model, normalizer=tokenizer.normalizer,
                splitter=tokenizer.pre_tokenizer, as_bytes=as_bytes, words={}, pieces={}, special=re.compile("|".join(special) or r"(?!)"),
            )
        self.__dict__.update(held)
        self.end_id = end_id

    def _tokenized(self, piece: str, as_bytes: str) -> bytes:
        """Ids of a piece, which is kept as it is; the bytes of other letters have marks that no plain piece has."""
        ids = array("H", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()
        if len(self.pieces) >= PIECES_KEPT:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def _plain(self, words: pa.Array) -> pa.Array:
        """Ids of plain words, as bytes."""
        if not len(words):
            return pa.array([], pa.large_binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        found = pa.array(PIECES.findall(f"{joined.lower()}\n"), pa.large_string()).dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        end = pieces.index("\n")
        held = list(map(self.pieces.get, pieces))
        held[end] = b""
        try:
            at = 0
            while True:  # until no piece is left without ids
                at = held.index(None, at)
                piece = pieces[at]
                held[at] = self._tokenized(piece, piece if piece.isascii() else piece.translate(self.as_bytes))
        except ValueError:
            pass
        codes = found.indices
        ids = pa.array(held, pa.large_binary()).take(codes)
        offsets = np.append(0, np.frombuffer(ids.buffers()[1], np.int64)[np.flatnonzero(codes.to_numpy() == end)])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), ids.buffers()[2]])

    def _odd(self, word: str) -> bytes:
        # Special tokens are what the file says they are, also inside a word.
        if len(word) > 1000 or ("<" in word and self.special.search(word)):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        ids = self.words.get(word)
        if ids is None:
            parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))
            ids = b"".join([self.pieces.get(p) or self._tokenized(p, p) for p, _ in parts])
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text begins, with the end of the last."""
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        every = words.flatten().dictionary_encode()
        distinct = every.dictionary
        plain = pc.and_(pc.match_substring_regex(distinct, PLAIN_WORDS), pc.less_equal(pc.utf8_length(distinct), 1000))
        plain = pc.and_not(plain, pc.match_substring(distinct, "<"))
        odd = pa.array([self._odd(w) for w in distinct.filter(pc.invert(plain)).to_numpy(zero_copy_only=False)], pa.large_binary())
        kinds = pa.concat_arrays([self._plain(distinct.filter(plain)), odd])
        place = np.empty(len(distinct), np.int64)
        place[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(distinct))
        ids = kinds.take(pa.array(place[every.indices.to_numpy()]))
        after = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64))
        starts = np.frombuffer(ids.buffers()[1], np.int64)[after] // 2
        data = ids.buffers()[2]
        flat = np.frombuffer(data, "<u2", starts[-1]) if data and starts[-1] else np.zeros(0, "<u2")
        if self.end_id is None:
            return flat, starts
        return np.insert(flat, starts[1:], self.end_id), starts + np.arange(len(starts))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]
