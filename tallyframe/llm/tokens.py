"""Token ids from a tokenizers file, at the speed of a dictionary.

The byte-level pattern never lets a token cross a space that stands before a character other than white space. So a text is cut
there, each distinct piece is encoded by the tokenizers library, and a bounded cache serves the repeats. The ids are those of the
whole text. A text that contains an added token of the file (its end-of-text mark) goes through the library in one piece.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Before such a space a new token begins; Python counts a few more characters as white space than the tokenizers do, which only
#: leaves a piece longer.
CUT = re.compile(r" (?=\S)")
#: Some space isn't like that.
OTHER = re.compile(r" (?=\s|\Z)")
#: The same for texts in ASCII.
SPACED = tuple(f" {chr(c)}" for c in (*range(9, 14), *range(28, 33)))
MARKS = frozenset(".,;:!?")
#: Words that are Python objects at a time.
STEP = 20_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def spaced(text: str) -> tuple[str, list[str]]:
    """A text as its head and what follows each space that begins a new token."""
    head, *rest = CUT.split(text) if unsure(text) else text.split(" ")
    return head, rest


def unsure(text: str) -> bool:
    """Does some space of a text not begin a new token?"""
    return any(map(text.__contains__, SPACED)) or text[-1] == " " if text.isascii() else OTHER.search(text) is not None


def _cuts(text: str, most: int) -> Iterator[str]:
    """A long text that splits at every space, in parts that begin new tokens."""
    at = 0
    while at < len(text):
        upto = text.find(" ", at + most)
        upto = len(text) if upto < 0 else upto
        yield text[at:upto]
        at = upto


def offsets_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)


def _printable() -> dict[int, str]:
    """The character that the byte-level alphabet has for each byte: itself if it shows, else the next one from U+0100."""
    shows = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shows)]
    return {b: chr(b) for b in shows} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def matches(find: Callable[[str], list[str]], word: str) -> list[str]:
    """The pattern's matches in a word after its space; most words are letters, letters and a mark, or the like on two lines, and need no
    search."""
    if word.isalpha():
        return [f" {word}"]
    last, line, first = word.partition("\n")
    if last and (not line or first.isalpha()):
        stem, mark = (last[:-1], [last[-1]]) if last[-1] in MARKS else (last, [])
        if stem.isalpha():
            return [f" {stem}", *mark, *(["\n", first] if line else [])]
    return find(f" {word}")


def split_texts(texts: pa.Array) -> pa.ListArray:
    """Each text as its head and what follows each space that begins a new token; an empty one has nothing."""
    plain, mixed, empty = [], [], []
    for k, text in enumerate(texts.to_pylist()):
        (empty if not text else mixed if unsure(text) else plain).append((k, text))
    lists = pc.split_pattern(texts.take(pa.array([k for k, _ in plain], pa.int32())), " ")
    rest = pa.array([[head, *words] for head, words in (spaced(text) for _, text in mixed)] + [[]] * len(empty), lists.type)
    order = np.array([k for k, _ in plain + mixed + empty], np.int64)
    return pa.concat_arrays([lists, rest]).take(pa.array(np.argsort(order)))


def pieces_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All pieces, where each text's begin, and which of them are heads."""
    values, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    first = np.zeros(len(values), bool)
    first[starts[:-1][sizes > 0]] = True
    return values, starts, first


def joined_up(lengths: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
    """Runs of binary values, of these lengths, each as one value."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), values), pa.scalar(b"", pa.binary()))


def spaced_out(words: pa.Array) -> pa.Array:
    """Words with a space before each, as bytes."""
    return pc.binary_join_element_wise(" ", words, "").cast(pa.binary())


class Encoder:
    """Texts to ids, as the tokenizers library gives them without special tokens, little-endian unsigned 32-bit integers.

    Texts are encoded some megabytes at a time: every distinct word of these is looked up once in a table of known pieces (with the
    space before them), and the ids of all places are gathered at once. Only pieces that the table lacks go to the tokenizer: one match
    of its pattern to its model, and what holds letters beyond Latin whole. ``pieces`` bounds the table, which then starts anew.
    """

    def __init__(self, path: str, pattern: str, pieces: int = 600_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.find, self.alphabet = self.tokenizer.model, regex.compile(pattern).findall, _printable()
        self.space, self.pieces, self.longest = self.alphabet[32], pieces, longest
        self.keys, self.codes = pa.array([], pa.binary()), pa.array([], pa.binary())

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def match(self, match: str) -> bytes:
        """One match of the pattern, or a piece with letters beyond Latin."""
        if match.isascii() and match[0] == " " and match[1:].isalpha():  # letters are themselves in the byte-level alphabet
            return array("I", [t.id for t in self.model.tokenize(self.space + match[1:])]).tobytes()
        if max(match) >= "\u0250":
            return self.whole(match)
        return array("I", [t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _split(self, words: pa.Array, apart: bool) -> tuple[pa.Array, np.ndarray]:
        """The matches of words that follow a space, or of heads (apart), one after the other, and how many each has.

        Beyond Latin the library's own pattern decides: such a piece stays whole.
        """
        flat, sizes = [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
        for at in range(0, len(words), STEP):  # what is held as Python objects stays small
            if apart:
                own = [([h] if max(h) >= "\u0250" else self.find(h)) if h else [] for h in words.slice(at, STEP).to_pylist()]
            else:
                own = [matches(self.find, w) if w.isascii() or max(w) < "\u0250" else [f" {w}"] for w in words.slice(at, STEP).to_pylist()]
            flat.append(pa.array([m.encode() for split in own for m in split], pa.binary()))
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        return pa.concat_arrays(flat), np.concatenate(sizes)

    def _learnt(self, words: pa.Array, times: np.ndarray, heads: pa.Array) -> pa.Array:
        """The ids of words that the table lacks and of heads. The table grows by those that came several times, and by their matches."""
        (flat, sizes), (more, head_sizes) = self._split(words, False), self._split(heads, True)
        met = pa.concat_arrays([flat, more]).dictionary_encode()
        index = met.indices.to_numpy()
        at = pc.fill_null(pc.index_in(met.dictionary, value_set=self.keys), -1).to_numpy().copy()
        fresh = np.flatnonzero(at < 0)
        new = met.dictionary.take(pa.array(fresh))
        codes = pa.concat_arrays([pa.array([], pa.binary()), *(pa.array([self.match(m.decode()) for m in new.slice(k, STEP).to_pylist()], pa.binary()) for k in range(0, len(new), STEP))])
        at[fresh] = len(self.keys) + np.arange(len(fresh))
        out = joined_up(np.r_[sizes, head_sizes], pa.concat_arrays([self.codes, codes]).take(pa.array(at[index])))
        # most words of a text of any length come once: they would only fill the table
        often = np.bincount(index, np.r_[np.repeat(times, sizes), np.ones(len(more))], len(at))[fresh] > 1
        kept = (sizes > 1) & (times > 1) & (pc.binary_length(words).to_numpy() <= self.longest)
        words = words.filter(pa.array(kept))
        self.keys = pa.concat_arrays([self.keys, new.filter(pa.array(often)), spaced_out(words)])
        self.codes = pa.concat_arrays([self.codes, codes.filter(pa.array(often)), out.slice(0, len(kept)).filter(pa.array(kept))])
        return out

    def batch(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """The ids of each text, with ``tail`` after them, as bytes."""
        apart = {k: text for k, text in enumerate(texts.to_pylist()) if text and any(map(text.__contains__, self.added))}
        if apart:
            texts = pa.array([None if k in apart else text for k, text in enumerate(texts.to_pylist())], pa.string())
        values, starts, first = pieces_of(split_texts(texts))
        distinct = values.dictionary_encode()
        index, words = distinct.indices.to_numpy(), distinct.dictionary
        if len(self.keys) > self.pieces:
            self.keys, self.codes = pa.array([], pa.binary()), pa.array([], pa.binary())
        place = pc.fill_null(pc.index_in(spaced_out(words), value_set=self.keys), -1).to_numpy().astype(np.int64)
        table = self.codes  # what place refers to
        times = np.bincount(index[~first], minlength=len(words))
        other, heads = np.flatnonzero((times > 0) & (place < 0)), np.unique(index[first])
        learnt = self._learnt(words.take(pa.array(other)), times[other], words.take(pa.array(heads)))
        place[other] = len(table) + np.arange(len(other))
        of_head = np.zeros(len(place), np.int64)
        of_head[heads] = len(table) + len(other) + np.arange(len(heads))
        where = np.where(first, of_head[index], place[index]).astype(np.int32)
        where = np.insert(where, starts[1:], len(table) + len(learnt))  # the tail
        out = joined_up(np.diff(starts) + 1, pa.concat_arrays([table, learnt, pa.array([tail], pa.binary())]).take(pa.array(where)))
        if apart:
            out = pa.array([self.whole(apart[k]) + tail if k in apart else code for k, code in enumerate(out.to_pylist())], pa.binary())
        return out

    def batches(self, texts: pa.Array, tail: bytes = b"", most: int = 12 << 20) -> Iterator[pa.Array]:
        """The same for some megabytes of texts at a time, in order. A longer text is cut where tokens begin, so only its ids grow."""
        texts = texts.cast(pa.string())
        ends, at = np.cumsum(np.diff(offsets_of(texts)), dtype=np.int64), 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            upto = min(len(texts), max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            part = texts.slice(at, upto - at)
            long = part[0].as_py() if upto - at == 1 and int(ends[at]) - before > most else None
            if long and not unsure(long) and not any(map(long.__contains__, self.added)):
                codes = [self.batch(pa.array([cut])) for cut in _cuts(long, most)]
                yield joined_up([len(codes) + 1], pa.concat_arrays([*codes, pa.array([tail], pa.binary())]))
            else:
                yield self.batch(part, tail)
            pa.default_memory_pool().release_unused()
            at = upto

    def __call__(self, text: str) -> bytes:
        """One text's ids."""
        return self.batch(pa.array([text], pa.string()))[0].as_py()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker: its table serves all its tasks."""
    return Encoder(path, pattern)
