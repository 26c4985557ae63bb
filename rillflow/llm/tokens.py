"""Token ids of whole Arrow batches by a public tokenizer file."""

from __future__ import annotations

import ctypes
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillflow.llm.wordhash import chunks, string_buffers

PART_BYTES = 16 << 20
PIECES_AT_ONCE = 8_192
WORDS_IN_TEXT = 64
LATIN = "a-zß-öø-ÿÀ-ÖØ-Þ"

SLICE_IDS = 1 << 20
#: The steps of a tokenizer for which pieces between white space, and full stops and commas after a letter, may be encoded apart.
STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each (start, length), one run after the other."""
    total = int(lens.sum())
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return out


def release_memory() -> None:
    """Give freed memory back to the system: workers live on, and several share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def may_cut(settings: dict) -> bool:
    """Whether a tokenizer's own settings say that cutting texts at white space changes no id."""
    steps = (settings["normalizer"] or {}).get("normalizers", [])
    before = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split = before[0].get("pattern") == {"Regex": SPLIT} and before[0].get("behavior") == "Removed" and before[0].get("invert") is True
    plain = [b.get("type") for b in before[1:]] == ["ByteLevel"] and not before[1].get("add_prefix_space") and not before[1].get("use_regex")
    return tuple(steps) == STEPS and split and plain and settings["truncation"] is None and all(t["content"].startswith("<|") for t in settings["added_tokens"])


class Encoder:
    """Ids of documents by a tokenizer file; end_id, if any, ends each.

    If the file's settings allow it (`may_cut`), texts are cut; otherwise each is encoded whole.
    Each distinct piece between white space is encoded once a batch; full stops
    and commas that follow a Latin letter are pieces of their own, as the
    tokenizer's own pattern ends a run of letters there. Documents in which the
    text of an added token may stand are encoded whole.
    """

    def __init__(self, tokenizer_file: str, end_id: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.end_id, self.cuts = end_id, may_cut(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.small = max(vocabulary.values()) < 1 << 16
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a few texts at a time, as the tokenizer's own results are large."""
        out = []
        for at in range(0, len(texts), PIECES_AT_ONCE):
            some = self.tokenizer.encode_batch_fast(texts[at : at + PIECES_AT_ONCE], add_special_tokens=False)
            out += [np.array(x.ids, np.uint32) for x in some]
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids, place of the first id) for distinct pieces.

        Pieces of Latin letters alone are one word to the tokenizer; many are
        encoded as one text and told apart by the ids that end a word.
        """
        plain = pc.match_substring_regex(pieces, f"^[{LATIN}]+$")
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))])
        words, rest = pieces.filter(plain).to_pylist(), pieces.filter(pc.invert(plain)).to_pylist()
        texts = [" ".join(words[at : at + WORDS_IN_TEXT]) for at in range(0, len(words), WORDS_IN_TEXT)]
        parts = []
        for at in range(0, len(texts), PIECES_AT_ONCE // WORDS_IN_TEXT):
            some = self.tokenizer.encode_batch_fast(texts[at : at + PIECES_AT_ONCE // WORDS_IN_TEXT], add_special_tokens=False)
            parts += [np.array(x.ids, np.uint32) for x in some]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words):  # a tokenizer without marks at the ends of words
            parts = self._ids(words)
            flat, lens = np.concatenate(parts) if parts else flat, np.array([len(x) for x in parts], np.int64)
        else:
            lens = np.diff(ends, prepend=0)
        others = self._ids(rest)
        flat = np.concatenate([flat, *others])
        out = np.empty(len(pieces), np.int64)
        out[order] = np.concatenate([lens, np.array([len(x) for x in others], np.int64)])
        starts = np.empty(len(pieces), np.int64)
        starts[order] = np.cumsum(out[order]) - out[order]
        return flat, out, starts

    def encode(self, column: pa.Array):
        """Yield (first row, ids, bounds) for slices of rows: row first + i has ids[bounds[i]:bounds[i+1]]; null is empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "") if column.null_count else column
        for a, b in chunks(string_buffers(column)[1], PART_BYTES):
            for row, ids, bounds in self._encode_part(column.slice(a, b - a)):
                yield a + row, ids, bounds
            release_memory()

    def _encode_whole(self, column: pa.Array):
        end = [] if self.end_id is None else [self.end_id]
        for row in range(0, len(column), 256):
            ids = [np.append(x, np.array(end, np.uint32)) for x in self._ids(column.slice(row, 256).to_pylist())]
            yield row, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def _encode_part(self, column: pa.Array):
        if not self.cuts:
            yield from self._encode_whole(column)
            return
        odd = np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False))
        whole = dict(zip(odd.tolist(), self._ids([column[int(i)].as_py() for i in odd]))) if len(odd) else {}
        text = pc.replace_substring_regex(pc.ascii_lower(column), pattern=f"([{LATIN}])([.,])", replacement=r"\1 \2")
        pieces = pc.ascii_split_whitespace(text)
        first = np.asarray(pieces.offsets, dtype=np.int64)
        coded = pieces.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        codes = coded.indices.to_numpy()
        del text, pieces
        flat, lens, starts = self._pieces(coded.dictionary)
        if self.end_id is not None:
            starts, lens = np.append(starts, len(flat)), np.append(lens, 1)
            flat = np.append(flat, np.uint32(self.end_id))
        each = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lens[codes], out=each[1:])
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(each[first], each[first[row]] + SLICE_IDS, "right")) - 1)
            stop = min(stop, len(column))
            own = codes[first[row] : first[stop]]
            if self.end_id is not None:
                own = np.insert(own, first[row + 1 : stop + 1] - first[row], len(lens) - 1)
            bounds = each[first[row : stop + 1]] - each[first[row]] + np.arange(stop - row + 1) * (self.end_id is not None)
            ids = flat[expand(starts[own], lens[own])]
            if any(row <= i < stop for i in whole):
                end = [] if self.end_id is None else [self.end_id]
                rows = [np.append(whole[i], np.array(end, np.uint32)) if i in whole else ids[bounds[i - row] : bounds[i - row + 1]] for i in range(row, stop)]
                ids, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            yield row, ids, bounds
            row = stop


