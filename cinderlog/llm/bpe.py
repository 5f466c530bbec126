"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The corpus' most frequent words (pre-tokens) are counted in Spark and compiled with
their ids into a minimal acyclic automaton whose equal suffixes are shared. Each edge
carries a number; a word's numbers add up to its rank among the sorted words, which
addresses its ids. Workers memory-map the compiled file. Words outside it are merged
exactly by the vocabulary's merge ranks, many at a time.

Cases: null text is empty and gives no ids; a text of any length is encoded whole;
repeated rows give repeated rows; an empty table gives an empty result; other columns
of the input are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, docs_of, map_arrow, span_hashes

#: Words of the lexicon at most: 65,536 words of 64 bytes compile to under 40 MB, whatever the corpus.
LEXICON_WORDS = 1 << 16
#: Longer words are neither compiled nor merged in a matrix.
MATRIX_BYTES = 64
#: Words whose ids a worker keeps: about 60 MB.
CACHE_WORDS = 400_000
NONE = np.int32(2**31 - 1)

#: Texts whose words can be cut by byte classes; others are cut with the vocabulary's pattern.
_PLAIN = re.compile("[\x00-\x1b\x20-&(-\x7fÀ-ÖØ-öø-įı-ſ]*")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE_CLASS, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE_CLASS


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(rest)) for b in range(256)]


def _old_characters() -> np.ndarray:
    """By code point, whether Unicode 3.2 has the character: how a text of such ones is normalised, cased and cut is the same in all later tables."""
    global _OLD
    if _OLD is None:
        category = unicodedata.ucd_3_2_0.category
        _OLD = np.array([category(chr(i)) not in ("Cn", "Cs") for i in range(0x110000)])
    return _OLD


_OLD: np.ndarray | None = None


class Vocabulary:
    """Symbols, merge ranks and special tokens of a word-end BPE file, with an exact merge."""

    def __init__(self, path: str) -> None:
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letters = byte_characters()
        self.first = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (x if isinstance(x, list) else x.split(" ") for x in model["merges"])]
        self.merged = np.array([x[2] for x in pairs], np.int32)
        self.ranks = {(a, b): i for i, (a, b, _) in reversed(list(enumerate(pairs)))}
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("pairs of ids are kept in 32 bits")
        self._place(list(self.ranks), list(self.ranks.values()))
        left = np.repeat(np.arange(256), 256)
        right = np.tile(np.arange(256), 256)
        self.inner = self.rank(self.first[left], self.first[right])
        self.outer = self.rank(self.first[left], self.last[right])
        size = max(max(vocab.values()), *self.special.values()) + 1
        names = [b""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name.encode()
        self.names = names

    def _place(self, pairs: list[tuple[int, int]], ranks: list[int]) -> None:
        """A two-choice hash table: each pair of ids lies in one of two slots, with its rank."""
        bits = 17
        keys = np.array([a << 16 | b for a, b in pairs], np.uint64)
        self.shift = np.uint64(64 - bits)
        for seed in range(1, 1000):
            self.factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * seed + i)) & (2**64 - 1) | 1) for i in (0, 1)]
            at = [((keys * f) >> self.shift).astype(np.int64) + i * (1 << bits) for i, f in enumerate(self.factors)]
            one, two, own = at[0].tolist(), at[1].tolist(), [-1] * (2 << bits)
            for item in range(len(pairs)):
                slot = one[item]
                for _ in range(300):
                    own[slot], item = item, own[slot]
                    if item < 0:
                        break
                    slot = two[item] if slot == one[item] else one[item]
                else:
                    break
            else:
                table = np.array(own)
                filled = keys << np.uint64(32) | np.array(ranks, np.uint64)
                self.slots = np.where(table >= 0, filled[table], np.uint64(2**64 - 1))
                return
        raise ValueError("no placement of the merge pairs was found")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge."""
        keys = left.astype(np.uint64) << np.uint64(16) | right.astype(np.uint64)
        one = self.slots[((keys * self.factors[0]) >> self.shift).astype(np.int64)]
        two = self.slots[((keys * self.factors[1]) >> self.shift).astype(np.int64) + (len(self.slots) >> 1)]
        found = np.where(one >> np.uint64(32) == keys, one, np.where(two >> np.uint64(32) == keys, two, np.uint64(NONE)))
        return (found & np.uint64(2**32 - 1)).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact ids of words, each as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            if len(word) <= MATRIX_BYTES:
                by_length[len(word)].append(i)
            else:
                out[i] = np.array(self._merge_long(word), "<u4").tobytes()
        for length, at in by_length.items():
            for i in range(0, len(at), 4096):
                self._merge_matrix(words, at[i : i + 4096], length, out)
        return out

    def _merge_matrix(self, words: list[bytes], at: list[int], length: int, out: list[bytes]) -> None:
        """Merges the lowest-ranked, leftmost pair of every word at once, until none is left."""
        grid = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), length)
        ids = self.first[grid]
        ids[:, -1] = self.last[grid[:, -1]]
        pair = grid[:, :-1].astype(np.int64) << 8 | grid[:, 1:]
        ranks = np.concatenate([self.inner[pair[:, :-1]], self.outer[pair[:, -1:]]], 1) if length > 1 else pair
        where = np.array(at)
        width = length
        while True:
            best = ranks.argmin(1) if width > 1 else np.zeros(len(ids), np.int64)
            lowest = ranks[np.arange(len(ids)), best] if width > 1 else np.full(len(ids), NONE)
            done = lowest == NONE
            if done.any():
                full = ids[done].astype("<u4")
                for i, row in zip(where[done].tolist(), full, strict=True):
                    out[i] = row.tobytes()
                live = ~done
                ids, ranks, where, best, lowest = ids[live], ranks[live], where[live], best[live], lowest[live]
            if not len(ids):
                return
            rows = np.arange(len(ids))
            columns = np.arange(width - 1)
            source = columns + (columns > best[:, None])
            ids = np.take_along_axis(ids, source, 1)
            ids[rows, best] = self.merged[lowest]
            width -= 1
            if width > 1:
                columns = columns[:-1]
                ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
                for left in (best - 1, best):
                    good = (left >= 0) & (left < width - 1)
                    r, c = rows[good], left[good]
                    ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one word of any length, with a heap of its pairs."""
        ids = [*self.first[np.frombuffer(word, np.uint8)].tolist()]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.merged[rank])
            live[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.ranks.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x, y in zip(ids, live, strict=True) if y]

    def pieces(self, text: str) -> list[str | int]:
        """Any text's words after normalisation; special tokens as their ids.

        Tables of newer characters differ between this Python and the library, so texts that have some are
        encoded by the library, and their ids stand for words.
        """
        if not _old_characters()[np.frombuffer(text.encode("utf-32-le"), "<u4")].all():
            return self._by_library(text)
        parts = self.special_pattern.split(text)
        if len(parts) > 1:
            return list(chain.from_iterable([self.special[x]] if x in self.special else self.pieces(x) for x in parts if x))
        return _PIECES.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str | int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return list(self.library.encode(text, add_special_tokens=False).ids)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the vocabulary has no decoder, so its symbols joined by spaces."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The process' copy of a vocabulary file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Pieces:
    """The words of some texts: a buffer, where words start and end in it, and each one's text.

    A special token is a word of one byte \x1c and its decimal id, which no pattern gives.
    """

    def __init__(self, vocabulary: Vocabulary, texts: list[str]) -> None:
        parts, plain = [], []
        for text in texts:
            if _PLAIN.fullmatch(text) and "<|" not in text:
                parts.append(text.lower().encode())
                plain.append(True)
            else:
                words = vocabulary.pieces(text)
                parts.append(" ".join([x if isinstance(x, str) else f"\x1c{x}" for x in words]).encode())
                plain.append(False)
        self.buffer = b"\n".join(parts)
        edges = np.cumsum([0, *(len(x) + 1 for x in parts)])
        data = np.frombuffer(self.buffer, np.uint8)
        kinds = np.zeros(len(data) + 2, np.uint8)
        kinds[1:-1] = _CLASS[data]
        for i, x in enumerate(plain):
            if not x:  # such words are cut at white space alone
                own = kinds[edges[i] + 1 : edges[i + 1]]
                own[own != _SPACE_CLASS] = _OTHER
        change = kinds[1:] != kinds[:-1]
        change |= kinds[1:] == _DIGIT
        filled = kinds != _SPACE_CLASS
        self.starts = np.flatnonzero(change & filled[1:])
        self.ends = np.flatnonzero(change & filled[:-1])
        self.text_at = np.searchsorted(self.starts, edges)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buffer, self.starts, self.ends)

    def differ(self, first: np.ndarray, inverse: np.ndarray) -> bool:
        """Whether some word isn't byte for byte the one that its hash stands for."""
        size = self.ends - self.starts
        if (size != size[first][inverse]).any():
            return True
        data = np.frombuffer(self.buffer, np.uint8)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return bool((data[np.repeat(self.starts, size) + step] != data[np.repeat(self.starts[first][inverse], size) + step]).any())

    def words(self, at: np.ndarray) -> list[bytes]:
        return [self.buffer[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Encoder:
    """Texts to ids: a bounded table of words met, then the lexicon if any, then exact merges.

    Words met are found again by a 64-bit hash, and their bytes are compared.
    """

    def __init__(self, path: str, lexicon: Transducer | None = None) -> None:
        self.vocabulary = vocabulary(path)
        self.lexicon = lexicon
        self.merged_words = 0
        self._reset()

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_at = np.empty((0, 3), np.int64)  # place and number of the ids, number of the word
        self.met: list[bytes] = []
        self.pool = np.empty(1 << 20, "<u4")
        self.used = 0

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids: by the lexicon, or merged."""
        found = self.lexicon.lookup(words) if self.lexicon is not None else [None] * len(words)
        for i, word in enumerate(words):
            if word[:1] == b"\x1c" and word[1:].isdigit():
                found[i] = np.array([int(word[1:])], "<u4").tobytes()
        rest = [i for i, x in enumerate(found) if x is None]
        self.merged_words += len(rest)
        for i, ids in zip(rest, self.vocabulary.merge([words[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def _new(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Adds words that weren't met."""
        found = self._ids_of(words)
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) // 4 for x in found])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.stack([self.used + np.cumsum(sizes) - sizes, sizes, len(self.met) + np.arange(len(words))], 1)
        self.met += words
        self.used += len(ids)
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.known_at = np.insert(self.known_at, where, at, 0)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text its ids (little-endian unsigned 32-bit integers)."""
        for group in _groups(texts):
            pieces = Pieces(self.vocabulary, group)
            unique, first, inverse = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
            at, good = self._find(unique)
            here = np.flatnonzero(good)
            known = [self.met[i] for i in self.known_at[at[here], 2].tolist()]
            if pieces.differ(first, inverse) or known != pieces.words(first[here]):
                yield from self._without_hashes(pieces)
                continue
            if not good.all():
                if len(self.known) + (~good).sum() > CACHE_WORDS:
                    self._reset()
                    good[:] = False
                self._new(unique[~good], pieces.words(first[~good]))
                at, good = self._find(unique)
            offset, size = self.known_at[at[inverse], :2].T if len(unique) else np.empty((2, 0), np.int64)
            after = np.cumsum(size)
            ids = self.pool[np.repeat(offset - after + size, size) + np.arange(after[-1] if len(after) else 0)]
            cuts = np.concatenate([[0], after])[pieces.text_at].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b]


    def _without_hashes(self, pieces: Pieces) -> Iterator[np.ndarray]:
        """The same where two words share a hash."""
        words = pieces.words(np.arange(len(pieces.starts)))
        different = sorted(set(words))
        ids = dict(zip(different, self._ids_of(different), strict=True))
        for a, b in zip(pieces.text_at.tolist(), pieces.text_at.tolist()[1:], strict=False):
            yield np.frombuffer(b"".join(ids[x] for x in words[a:b]), "<u4")


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about a million characters."""
    group: list[str] = []
    total = 0
    for text in texts:
        if group and total + len(text) > 1_000_000:
            yield group
            group, total = [], 0
        group.append(text)
        total += len(text)
    if group:
        yield group


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder without a lexicon."""
    if (path,) not in _ENCODERS:
        _ENCODERS[path,] = Encoder(path)
    return _ENCODERS[path,]


# -- the transducer ---------------------------------------------------------------

MAGIC = b"CLTRANS1"


def compile_transducer(words: Iterable[tuple[bytes, bytes]]) -> bytes:
    """Bytes of a minimal acyclic transducer for distinct (word, ids) pairs.

    Built from the sorted words, one path at a time: what can't change any more is
    replaced by an equal state that exists already, so suffixes are shared. An edge's
    number is how many words of its state sort before those through it.
    """
    entries = sorted(words)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]  # of unsettled states: final, edges; path[i + 1] hangs at path[i] by label[i]
    previous = b""
    for word, _ in entries:
        shared = 0
        while shared < min(len(previous), len(word)) and previous[shared] == word[shared]:
            shared += 1
        while len(path) - 1 > shared:
            final, edges = path.pop()
            path[-1][1].append((previous[len(path) - 1], settle(final, edges)))
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        final, edges = path.pop()
        path[-1][1].append((previous[len(path) - 1], settle(final, edges)))
    root = settle(*path[0])

    sizes = []
    edge_keys, targets, numbers = [], [], []
    for i, (final, edges) in enumerate(states):  # targets come before the states that lead to them
        total = int(final)
        for label, target in edges:
            edge_keys.append(i << 8 | label)
            targets.append(target)
            numbers.append(total)
            total += sizes[target]
        sizes.append(total)
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)]) // 4
    arrays = [
        np.array(edge_keys, "<i8"), np.array(targets, "<i4"), np.array(numbers, "<i4"), np.array([x[0] for x in states], "u1"), starts.astype("<i4"), np.frombuffer(b"".join(ids for _, ids in entries), "<u4"),
    ]
    head = MAGIC + np.array([root, *(len(x) for x in arrays)], "<i8").tobytes()
    body = b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays)
    return head + body


class Transducer:
    """A compiled transducer over a buffer, such as a memory-mapped file."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        if buffer[:8] != MAGIC:
            raise ValueError("not a transducer")
        self.root, *lengths = np.frombuffer(buffer, "<i8", 7, 8).tolist()
        at, arrays = 64, []
        for n, kind in zip(lengths, ("<i8", "<i4", "<i4", "u1", "<i4", "<u4"), strict=True):
            arrays.append(np.frombuffer(buffer, kind, n, at))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 8
        self.edges, self.targets, self.numbers, self.final, self.starts, self.ids = arrays
        self.states = len(self.final)

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word, None for words it doesn't have. Words of a length walk together."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.edges):
            return out
        by_length = defaultdict(list)
        for i, word in enumerate(words):
            if 0 < len(word) <= MATRIX_BYTES:
                by_length[len(word)].append(i)
        for length, at in by_length.items():
            grid = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), length)
            where, state, number = np.array(at), np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
            for j in range(length):
                keys = state << 8 | grid[:, j]
                edge = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
                good = self.edges[edge] == keys
                where, grid, edge = where[good], grid[good], edge[good]
                state, number = self.targets[edge].astype(np.int64), number[good] + self.numbers[edge]
            good = self.final[state] > 0
            for i, n in zip(where[good].tolist(), number[good].tolist(), strict=True):
                out[i] = self.ids[self.starts[n] : self.starts[n + 1]].tobytes()
        return out


def mapped(compiled: bytes) -> Transducer:
    """The transducer memory-mapped from a file of this machine, which goes with its last user."""
    with tempfile.NamedTemporaryFile(prefix="cinderlog-", suffix=".fst") as file:
        file.write(compiled)
        file.flush()
        return Transducer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


# -- Spark ------------------------------------------------------------------------


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the most frequent words of all texts, at most `limit` of them.

    Each task adds up the counts of a batch before they are shuffled. The least count comes
    from a histogram of counts in steps of 1/16 of their logarithm; words of a step stay or
    go together, so no task sorts the words of all tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocab = vocabulary(path)
        for batch in batches:
            for group in _groups([x or "" for x in batch.column("text").to_pylist()]):
                pieces = Pieces(vocab, group)
                _, first, n = np.unique(pieces.hashes(), return_index=True, return_counts=True)
                short = pieces.ends[first] - pieces.starts[first] <= MATRIX_BYTES
                words = [x.decode() for x in pieces.words(first[short])]
                yield {"word": words, "n": n[short]}

    counts = map_arrow(docs.select("text"), count, "word string, n long")
    total = cut(counts.groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log2("n") * 16).cast("int")))
    least, words = None, 0
    for step, n in sorted(total.groupBy("step").count().collect(), reverse=True):
        words += n
        if words > limit:
            break
        least = step
    return total.where(F.col("step") >= least if least is not None else F.lit(False)).select("word", "n")


def build_lexicon(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> bytes:
    """Compiles the frequent words; at most `limit` words come to the driver."""
    vocab = vocabulary(path)
    words = [x.word.encode() for x in frequent_words(docs, path, limit).select("word").toLocalIterator()]
    words = [x for x in words if len(x) <= MATRIX_BYTES]
    return compile_transducer(zip(words, vocab.merge(words), strict=True))


def encode_decode(documents: DataFrame, path: str, limit: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every text."""
    docs = docs_of(documents)
    compiled = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key = (path, hashlib.sha256(compiled.value).digest())
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(path, mapped(compiled.value))
        own = _ENCODERS[key]
        for batch in batches:
            n, ids_hash, decoded_hash, all_ids, all_decoded = [], [], [], [], []
            for ids in own.encode([x or "" for x in batch.column("text").to_pylist()]):
                raw = ids.tobytes()
                decoded = own.vocabulary.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                decoded_hash.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(ids.tolist())
                    all_decoded.append(decoded.decode())
            yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": decoded_hash, "ids": all_ids, "decoded": all_decoded}

    return map_arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids)
