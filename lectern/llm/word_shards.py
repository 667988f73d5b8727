"""The word model of ``word_model`` over packed exchanges, for corpora that are large beside the disk.

Documents stay where they are read. A task packs the distinct trigrams of its documents
and sends each once to the shard of its middle word, with its number in trusted documents.
A shard so holds all that the counts, contexts and lower orders of its words need. It
answers every pack in the order asked, with whole numbers; the tasks read their documents
again, put the probabilities together and sum them by document. So the exchanges hold a
trigram once per pack, sorted and as differences, and no text, weight or posting.

Common words travel as a rank in the trusted text (at most ``CODES``), others as their
hash, and words that no trusted text has as one: no model knows them, so nothing is asked
after one. Ranks and the bits that tell unknown words only shorten what is sent, no count
or result depends on them. A pack has documents of one half: it trains that half's model
and asks the other.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.word_scan import Scanner, chunks, give_back, kinds

#: Words that travel as a rank.
CODES = 1_000_000
#: Characters of text for each shard and each pack, about.
SHARD_CHARS, PACK_CHARS = 15_000_000, 20_000_000
#: The end of a text and words as they travel: unknown ones, ranks, others by a hash below 0, of which 7 bytes are sent.
END, UNKNOWN, FIRST = 1, 2, 3
_SENT = 7
#: Words counted between two sums of a task, and in a batch.
_KEPT = 2_000_000
#: Bits for a word without a rank, and how many bits of its hash tell its bit at most (16 MB).
_SPARSE, _BITS = 8, 27
_PLACE = f"(word & {(1 << _BITS) - 1})"
_LOW, _SIGN = (1 << 8 * _SENT) - 1, -(1 << 8 * _SENT)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of the texts and their borders."""
    known = kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, held, size = Scanner(known), [], 0
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: (r[0] is not None, r[0] or ""))
            for lang, texts in groupby(rows, itemgetter(0)):
                texts = [text or "" for _, text in texts]
                held.append((scanner.hashed(lang, ["\n"]), np.array([2 * len(texts)])))
                held += [np.unique(scanner.words(lang, text)[0], return_counts=True) for text, _, _ in chunks(texts)]
            if sum(len(word) for word, _ in held) > size + _KEPT:
                held = [summed(held)]
                size = len(held[0][0])
        if held:
            word, n = summed(held)
            for at in range(0, len(word), _KEPT):
                columns = [pa.array(x[at : at + _KEPT]) for x in (word, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])
            del held, word, n
        give_back()

    # Words whose bits are neighbours stay together, for ``bits_of``.
    near = F.expr(f"{_PLACE} >> 17")
    counted = docs.select("lang", "text").mapInArrow(run, "word long, n long").repartition(near)
    return counted.groupBy(near.alias("near"), "word").agg(F.sum("n").alias("n")).drop("near")


def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order, with the sum of their numbers."""
    return _grouped(*(np.concatenate(x) for x in zip(*parts)))


def bits_of(words: DataFrame, n: int) -> np.ndarray:
    """A bit for each of n words, by its hash; at most 2 ** _BITS bits, of which all may be set."""
    bits = min(max((_SPARSE * n).bit_length(), 17), _BITS)
    cell, bit = F.expr(f"{_PLACE} >> {_BITS - bits + 6}"), F.expr(f"shiftleft(1L, int(({_PLACE} >> {_BITS - bits}) & 63))")
    found = words.groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.int64)
    table[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return table


def has_bit(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = (hashes & ((1 << _BITS) - 1)) >> (_BITS - 6 - (len(table).bit_length() - 1))
    return table[place >> 6] >> (place & 63) & 1 > 0


def ranks(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words in their order, and bits of the others."""
    counts = common.stage(word_counts(docs), "ranks")
    # The least number that leaves CODES words at most: frequent words are few.
    sizes = sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect(), reverse=True)
    least, held = 10_001, 0
    for n, count in sizes:
        if held + count > CODES:
            break
        least, held = n, held + count
    table = counts.where(F.col("n") >= least).toArrow()
    word, n = table["word"].to_numpy(), table["n"].to_numpy()
    rare = counts.where(F.col("n") < least)
    return word[np.lexsort((word, -n))], bits_of(rare, sum(count for _, count in sizes) - held)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few byte planes as the largest needs."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(values).to_bytes(4, "little") + (pa.Codec("zstd", 6).compress(planes, asbytes=True) if planes else b"")


def spread(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    values = np.zeros((n, 8), np.uint8)
    if width and n:
        planes = pa.Codec("zstd").decompress(data[5:], width * n, asbytes=True)
        values[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return values.reshape(-1).view(np.int64)


def _sent(words: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes]:
    """Words in order inside groups that begin where ``first``, as differences of ranks, and the hashes of the others."""
    other = words < 0
    rank = np.where(other, CODES + FIRST, words)
    step = np.diff(rank, prepend=0)
    step[first] = rank[first]
    return squeeze(step), words[other].view(np.uint8).reshape(-1, 8)[:, :_SENT].tobytes()


def _read(sent: tuple[bytes, bytes], first: np.ndarray) -> np.ndarray:
    step = spread(sent[0])
    total = np.cumsum(step)
    words = total - np.repeat((total - step)[first], np.diff(np.append(first, len(step))))
    hashes = np.full((len(sent[1]) // _SENT, 8), 255, np.uint8)
    hashes[:, :_SENT] = np.frombuffer(sent[1], np.uint8).reshape(-1, _SENT)
    words[words == CODES + FIRST] = hashes.reshape(-1).view(np.int64)
    return words


def _sums(rows: np.ndarray) -> list[bytes]:
    """Rows of ``_stats``: where there is any, and there the numbers, the sum without what they make up."""
    seen = rows[0] > 0
    total, ones, twos, more = rows[:, seen]
    return [squeeze(np.packbits(seen)), *map(squeeze, (total - ones - 2 * twos - 3 * more, ones, twos, more))]


def _read_sums(sent: list[bytes], n: int) -> np.ndarray:
    seen, total, ones, twos, more = map(spread, sent)
    rows = np.zeros((4, n), np.int64)
    rows[:, np.unpackbits(seen.astype(np.uint8), count=n) > 0] = total + ones + 2 * twos + 3 * more, ones, twos, more
    return rows


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes & _LOW) % shards


def hashed(lang: str | None, words: list[str]) -> np.ndarray:
    """A hash of each word of a language; both halves share it."""
    return Scanner(kinds()).hashed(lang, words)


def _coded(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Words as they travel; ``table``: hashes by rank, and ranks by hash."""
    by_rank, ranked = table[:2]
    if not len(by_rank):
        return hashes | _SIGN
    at = ranked[np.minimum(np.searchsorted(by_rank, hashes, sorter=ranked), len(ranked) - 1)]
    return np.where(by_rank[at] == hashes, at + FIRST, hashes | _SIGN)


def _first(values: np.ndarray) -> np.ndarray:
    """Where another value stands than before."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def _coded_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its place among the distinct ones, which stand as they come."""
    if not len(keys):
        return np.zeros(0, np.int32), keys
    coded = pa.Array.from_buffers(pa.int64(), len(keys), [None, pa.py_buffer(keys)]).dictionary_encode()
    place, distinct = coded.indices, coded.dictionary
    return np.frombuffer(place.buffers()[1], np.int32, len(place)), np.frombuffer(distinct.buffers()[1], np.int64, len(distinct))


def _firsts(places: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Of each of n places, the value where it stands first."""
    first = np.empty(n, values.dtype)
    first[places[::-1]] = values[::-1]
    return first


class Pack:
    """Distinct trigrams of documents of one half, by shard; the same for any order of the documents."""

    def __init__(
        self, docs: list[tuple], table: tuple[np.ndarray, np.ndarray], shards: int,
        scanner: Scanner | None = None, judged: bool = False, bits: np.ndarray | None = None,
    ):
        """``docs``: (lang, text, good), by language; ``bits``: without them, trusted texts may have any word.

        Only with ``judged`` it knows each document's words, only without their numbers.
        """
        flat, hashes, lang, sizes = self._read(docs, scanner or Scanner(kinds()), judged)
        give_back()
        self.lang, self.sizes = lang, sizes
        sent = _coded(hashes, table)
        shard = shard_of(hashes, shards)
        unknown = (sent < 0) & ~has_bit(hashes, bits) if bits is not None else np.zeros(len(sent), bool)
        known = np.flatnonzero(~unknown)
        # Ranks go up, hashes stand after them.
        order = sent[known].view(np.uint64)
        middle = known[np.lexsort((order, lang[known], shard[known]))].astype(np.int32)
        # The end, all unknown words as one that stands after the others here, and the known ones.
        side = np.concatenate([[-1, len(sent)], known[np.lexsort((order,))]]).astype(np.int32)
        n = len(side)
        if n >= 1 << 21:
            raise ValueError(f"{n} words in a pack: lower PACK_CHARS")
        middle_of, side_of = np.zeros(len(sent), np.uint64), np.ones(len(sent) + 1, np.uint64)
        middle_of[middle], side_of[side[2:]], side_of[-1] = np.arange(n - 2), np.arange(2, n), 0
        self.sent = np.concatenate([sent, [UNKNOWN, END]])

        starts = np.cumsum(sizes + 3) - sizes - 3
        inside = np.ones(len(flat), bool)
        inside[starts] = inside[starts + 1] = False
        inside = np.flatnonzero(inside).astype(np.int32)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes + 1)
        asked = ~unknown[flat[inside - 1]]
        if judged:
            # Words that no trigram stands for: those after an unknown word, and unknown ones.
            alone = np.flatnonzero(flat[inside] >= 0)
            alone = alone[~asked[alone] | unknown[flat[inside[alone]]]]
            self.alone = doc[alone], flat[inside[alone]]
        inside, doc = inside[asked], doc[asked]
        bits = n.bit_length()
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        keys = middle_of[flat[inside - 1]]
        keys <<= shift
        keys |= side_of[flat[inside - 2]]
        keys <<= shift
        keys |= side_of[flat[inside]]
        del inside, flat, asked
        give_back()
        if judged:
            order = np.argsort(keys)
            keys = keys[order]
            new = _first(keys)
            self.found = np.empty(len(keys), np.int32)
            self.found[order] = np.cumsum(new, dtype=np.int32) - 1
            self.doc = doc
            keys = keys[new]
            del order
        else:
            keys <<= np.uint64(1)
            keys |= np.array([g > 0 for _, _, g in docs], np.uint64)[doc]
            keys.sort()
            good = (keys & np.uint64(1)).astype(np.int32)
            keys >>= np.uint64(1)
            first = np.flatnonzero(_first(keys))
            keys, self.n = keys[first], np.add.reduceat(good, first)
            # The end of a text is no word of it, but says what stands before its last word.
            last = (keys & mask) == 0
            self.ended = last & (self.n > 0)
            self.n[last] = 0
            del good, first, last
        self.h0 = side[keys & mask]
        keys >>= shift
        self.new_pair = np.flatnonzero(_first(keys))
        keys = keys[self.new_pair]
        self.pair_word, self.h2 = middle[keys >> shift], side[keys & mask]
        word = np.flatnonzero(_first(self.pair_word))
        self.h1, self.new_word = self.pair_word[word], self.new_pair[word]
        self.shard = shard[self.h1]
        if judged:
            sizes = np.diff(np.append(self.new_pair, len(self.h0)))
            self.pair = np.repeat(np.arange(len(self.h2), dtype=np.int32), sizes)

    def _read(self, docs: list[tuple], scanner: Scanner, judged: bool) -> tuple:
        """All texts as places of words, between two borders and an end (-1); the words' hashes and languages; words of each text."""
        self.langs, distinct, langs, codes, held, size = [], [], [], [], [], 0
        sizes, border, at = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), 0

        def add(hashes: np.ndarray, text: str, starts: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal size
            distinct.append(hashes)
            langs.append(np.full(len(hashes), len(self.langs) - 1))
            size += len(hashes)
            if judged:
                held.append((text, starts, sizes))

        for lang, texts in groupby(docs, itemgetter(0)):
            texts = [text for _, text, _ in texts]
            self.langs.append(lang)
            border[at : at + len(texts)] = size
            add(scanner.hashed(lang, ["\n"]), "\n", np.array([0]), np.array([1]))
            for text, numbers, ends in chunks(texts):
                hashes, starts, lengths = scanner.words(lang, text)
                np.add.at(sizes, at + np.array(numbers), np.diff(np.searchsorted(starts, ends), prepend=0))
                place, hashes = _coded_places(hashes)
                codes.append(place + np.int32(size))
                add(hashes, text, *(_firsts(place, len(hashes), x) if judged else x for x in (starts, lengths)))
            at += len(texts)
        place, hashes = _coded_places(np.concatenate(distinct))
        starts = np.cumsum(sizes + 3) - sizes - 3
        flat = np.empty(int(sizes.sum()) + 3 * len(docs), np.int32)
        words = np.ones(len(flat), bool)
        # The end stands for the last word being a context, which asks for that word's own numbers.
        for i, value in ((starts, place[border]), (starts + 1, place[border]), (starts + sizes + 2, -1)):
            words[i], flat[i] = False, value
        flat[words] = place[np.concatenate([np.zeros(0, np.int32), *codes])]
        self.border = np.zeros(len(hashes), bool)
        self.border[place[border]] = True
        if judged:
            first = _firsts(place, len(hashes), np.arange(len(place)))
            self.words, self.lengths, before = [], [], 0
            for text, begins, lengths in held:
                new = first[len(self.words) :]
                new = new[: np.searchsorted(new, before + len(begins))] - before
                self.words += [text[i:j] for i, j in zip(begins[new].tolist(), (begins + lengths)[new].tolist())]
                self.lengths.append(lengths[new])
                before += len(begins)
            self.lengths = np.concatenate(self.lengths)
        return flat, hashes, _firsts(place, len(hashes), np.concatenate(langs)), sizes

    def parts(self) -> Iterator[tuple]:
        """Per shard, the ranges of its words, pairs and trigrams."""
        first = np.flatnonzero(np.diff(self.shard, prepend=-1))
        words = np.append(first, len(self.h1))
        grams = np.append(self.new_word[first], len(self.h0))
        pairs = np.append(np.searchsorted(self.new_pair, grams[:-1]), len(self.h2))
        ranges = ([slice(int(i), int(j)) for i, j in zip(x, x[1:])] for x in (words, pairs, grams))
        yield from zip(self.shard[first].tolist(), *ranges)

    def mark(self, grams: slice) -> int:
        return crc32(self.sent[self.h0[grams]].tobytes())

    def asked(self, words: slice, pairs: slice, grams: slice) -> tuple:
        """What a shard gets: words by language, the pairs of each and the trigrams of each pair."""
        of_pair = self.new_pair[pairs] - grams.start
        of_word = np.searchsorted(of_pair, self.new_word[words] - grams.start)
        lang = self.lang[self.h1[words]]
        new = np.flatnonzero(np.diff(lang, prepend=-1))
        ended = self.ended[grams][self.h0[grams] == -1]
        return (
            ([(self.langs[lang[i]], int(i)) for i in new], np.flatnonzero(self.border[self.h1[words]]).tolist()),
            _sent(self.sent[self.h1[words]], new),
            squeeze(np.diff(np.append(of_word, len(of_pair)))),
            _sent(self.sent[self.h2[pairs]], of_word),
            squeeze(np.diff(np.append(of_pair, grams.stop - grams.start))),
            _sent(self.sent[self.h0[grams]], of_pair),
            squeeze(self.n[grams]),
            squeeze(np.packbits(ended)),
        )


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Asked:
    """A pack's part, read in its shard."""

    def __init__(self, part: tuple):
        (langs, self.border), words, pairs_of, before, grams_of, last, n, ended = part
        first = [i for _, i in langs]
        self.words = _read(words, np.array(first, np.int64))
        self.lang = np.repeat(np.arange(len(langs)), np.diff([*first, len(self.words)]))
        self.langs = [x for x, _ in langs]
        pairs_of, grams_of = spread(pairs_of), spread(grams_of)
        self.pair_word = np.repeat(np.arange(len(self.words), dtype=np.int32), pairs_of)
        self.before = _read(before, _starts(pairs_of))
        self.gram_pair = np.repeat(np.arange(len(grams_of), dtype=np.int32), grams_of)
        self.last = _read(last, _starts(grams_of))
        self.n = spread(n).astype(np.int32)
        ends = np.flatnonzero(self.last == END)
        self.ended = ends[np.unpackbits(spread(ended).astype(np.uint8), count=len(ends)) > 0]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    values = np.sort(values)
    return values[_first(values)]


def _grouped(key: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights or their number."""
    if weights is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(_first(key))
    return key[first], np.add.reduceat(weights[order], first) if len(first) else weights


def _stats(group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted groups: their keys, and in rows the sum of n and how many are 1, 2 and above."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    rows = np.stack([n, n == 1, n == 2, n > 2]).astype(np.int64)
    return group[first], np.add.reduceat(rows, first, axis=1) if len(first) else rows


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys along the last axis, 0 for keys that are not there."""
    if not len(keys):
        return np.zeros((*values.shape[:-1], len(asked)), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[..., at], 0)


class Shard:
    """Counts of one shard: all trigrams with its middle words, from all packs."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (pack, half, part)."""
        self.asked = [(pack, half, Asked(part)) for pack, half, part in rows]
        every = [a for _, _, a in self.asked]
        # In the order of the parts: ranks, then hashes.
        words = _distinct(np.concatenate([x for a in every for x in (a.words, a.before, a.last)]).view(np.uint64)).view(np.int64)
        w = self.w = len(words)
        if w >= 1 << 21:
            raise ValueError(f"{w} words in a shard: lower SHARD_CHARS")
        ranked = int(np.searchsorted(words.view(np.uint64), np.uint64(1 << 63)))
        places = np.zeros(int(words[ranked - 1]) + 1 if ranked else 0, np.int64)
        places[words[:ranked]] = np.arange(ranked)

        def place(asked: np.ndarray) -> np.ndarray:
            got, other = np.empty(len(asked), np.int64), asked < 0
            got[~other] = places[asked[~other]]
            got[other] = ranked + np.searchsorted(words[ranked:], asked[other])
            return got

        names = sorted({x for a in every for x in a.langs}, key=lambda x: (x is not None, x or ""))
        self.langs, self.lang, self.border = names, np.zeros(w, np.int64), np.zeros(w, bool)
        for a in every:
            a.word = place(a.words)
            self.lang[a.word] = np.array([names.index(x) for x in a.langs])[a.lang]
            self.border[a.word[a.border]] = True
            a.pair = a.word[a.pair_word] * w + place(a.before)
            a.after = place(a.last)
            a.words = a.before = a.last = None
        give_back()
        self.models = [self._model([a for _, half, a in self.asked if half == m]) for m in (0, 1)]

    def _model(self, packs: list[Asked]) -> tuple:
        """Trigrams, pairs, (middle, last) and words as contexts, and words after different ones, all with their numbers."""
        w = self.w
        used = [np.flatnonzero(a.n) for a in packs]
        none = np.zeros(0, np.int64)
        key = np.concatenate([none, *[a.pair[a.gram_pair[u]] * w + a.after[u] for a, u in zip(packs, used)]])
        grams = _grouped(key, np.concatenate([none, *[a.n[u] for a, u in zip(packs, used)]]))
        pairs = _stats(grams[0] // w, grams[1])
        lower = _grouped(grams[0] // (w * w) * w + grams[0] % w)
        words = _stats(lower[0] // w, lower[1])
        # A word after another is the middle of a trigram, or a text ends with it.
        after = _distinct(np.concatenate([pairs[0], *[a.pair[a.gram_pair[a.ended]] for a in packs]])) // w
        return grams, pairs, lower, words, np.unique(after[~self.border[after]], return_counts=True)

    def counts(self) -> Iterator[tuple]:
        """((half, lang, order), number of n-grams seen once, twice, three and four times)."""
        for half, (grams, _, lower, _, after) in enumerate(self.models):
            for order, (key, n), size in ((3, grams, self.w**2), (2, lower, self.w), (1, after, 1)):
                lang = self.lang[key // size]
                for i in np.unique(lang).tolist():
                    yield (half, self.langs[i], order), tallied(n[lang == i])

    def answers(self) -> Iterator[tuple]:
        """(pack, numbers in the order asked) by the model of the other half."""
        for pack, half, a in self.asked:
            grams, pairs, lower, words, after = self.models[1 - half]
            of_words, of_pairs = _look(*words, a.word), _look(*pairs, a.pair)
            # What was never seen in its context is not asked for.
            at = np.flatnonzero((of_words[0] > 0)[a.pair_word][a.gram_pair])
            two = _look(*lower, a.word[a.pair_word[a.gram_pair[at]]] * self.w + a.after[at])
            at = np.flatnonzero((of_pairs[0] > 0)[a.gram_pair])
            three = _look(*grams, a.pair[a.gram_pair[at]] * self.w + a.after[at])
            yield pack, [*_sums(of_words), squeeze(_look(*after, a.word)), *_sums(of_pairs), squeeze(two), squeeze(three)]


def tallied(n: np.ndarray) -> tuple:
    """How many are 1, 2, 3 and 4, all, and their sum."""
    return (*[int((n == k).sum()) for k in (1, 2, 3, 4)], len(n), int(n.sum()))


def added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def discounts(c: tuple) -> list[float]:
    y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.0
    raw = [k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def _context(numbers: np.ndarray, d: np.ndarray) -> np.ndarray:
    """In rows, the sum of a context and its rest for the lower order: 0 and 1 for a context never seen."""
    total, ones, twos, more = numbers
    rest = (d[0] * ones + d[1] * twos + d[2] * more) / np.maximum(total, 1)
    return np.stack([total, np.where(total == 0, 1.0, rest)])


def _chance(n: np.ndarray, at: np.ndarray, context: np.ndarray, d: np.ndarray, lang: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities by number, place of the context and the lower order; ``d`` by language, that by context."""
    logs = np.log(context[1])[at]
    logs += below
    seen = np.flatnonzero(n)
    n, at = n[seen], at[seen]
    share = (n - d[np.minimum(n, 3) - 1, lang[at]]) / context[0][at]
    logs[seen] = np.log(share + context[1][at] * np.exp(below[seen]))
    return logs


def logs_of(pack: Pack, half: int, answers: list[tuple], models: dict, spell) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a pack: the sum of its logarithms, and its characters with an end for each word."""
    spelled = spell(pack.words)
    give_back()
    by_shard = {shard: (mark, numbers) for shard, mark, numbers in answers}
    d = np.full((3, 3, len(pack.langs)), 0.5)
    lowest = np.zeros((4, len(pack.langs)), np.int64)
    for i, lang in enumerate(pack.langs):
        for order in (1, 2, 3):
            c = models.get((1 - half, lang, order))
            if c:
                d[order - 1, :, i] = discounts(c)
                if order == 1:
                    lowest[:, i] = c[5], c[0], c[1], c[4] - c[0] - c[1]
    # A word of one model, by its own numbers: asked as a context, like every known word of the pack.
    own, followed = np.stack([np.zeros(len(pack.words)), np.ones(len(pack.words))]), np.zeros(len(pack.words), np.int64)
    by_pair, two, three = np.empty((2, len(pack.h2))), *np.zeros((2, len(pack.h0)), np.int32)
    lang_of = pack.lang[pack.pair_word].astype(np.int32)
    for shard, words, pairs, grams in pack.parts():
        mark, numbers = by_shard.pop(shard)
        if mark != pack.mark(grams):
            raise RuntimeError("documents changed between two reads")
        h1, lang = pack.h1[words], lang_of[pairs]
        own[:, h1] = _context(_read_sums(numbers[:5], len(h1)), d[1][:, pack.lang[h1]])
        followed[h1] = spread(numbers[5])
        by_pair[:, pairs] = _context(_read_sums(numbers[6:11], len(lang)), d[2][:, lang])
        pair = pack.pair[grams]
        for found, seen, sent in ((two, own[0, pack.pair_word[pair]], 11), (three, by_pair[0, pair], 12)):
            found[grams.start + np.flatnonzero(seen)] = spread(numbers[sent])
    words = _chance(followed, pack.lang, _context(lowest, d[0]), d[0], np.arange(len(pack.langs)), spelled)
    logs = np.append(words, [0.0, 0.0])[pack.h0]
    logs = _chance(two, pack.pair_word[pack.pair], own, d[1], pack.lang, logs)
    logs = _chance(three, pack.pair, by_pair, d[2], lang_of, logs)
    logs[pack.h0 == -1] = 0.0
    del two, three, by_pair
    doc, word = pack.alone
    size = np.append(pack.lengths + 1, [0, 0])
    # Without any word alone these are whole numbers.
    sums = [np.bincount(doc, x[word], len(pack.sizes)).astype(np.float64) for x in (words, size)]
    for at in range(0, len(pack.doc), _KEPT >> 2):
        doc, gram = (x[at : at + (_KEPT >> 2)] for x in (pack.doc, pack.found))
        sums[0] += np.bincount(doc, logs[gram], len(pack.sizes))
        sums[1] += np.bincount(doc, size[pack.h0[gram]], len(pack.sizes))
    return sums[0], sums[1]


def packs(rows: list) -> Iterator[tuple[int, int, list[int]]]:
    """(number, half, places of rows) of a partition, whatever its order."""
    n = 1 + sum(len(r.text) for r in rows) // PACK_CHARS
    held = defaultdict(list)
    for i, r in enumerate(rows):
        held[r.half * n + r.part % n, r.half].append(i)
    for (number, half), at in sorted(held.items()):
        yield number, half, sorted(at, key=lambda i: (rows[i].lang is not None, rows[i].lang or ""))


def score(rows: DataFrame, spellers) -> DataFrame:
    """Per row of (doc_id, lang, text, half, part, good): doc_id, lang, n_symbols, perplexity.

    ``half`` is the model that a good row trains; the other one scores it. ``part`` is any
    number made from the text, to cut large partitions.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    schema = "doc_id long, lang string, n_symbols long, perplexity double"
    hashes, bits = ranks(rows.where("good = 1"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    table = sc.broadcast((hashes, np.argsort(hashes).astype(np.int32), bits))
    # Both passes read the same partitions.
    docs = rows.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"), "half", "part", "good").rdd
    if not docs.getNumPartitions():
        return spark.createDataFrame([], schema)
    known = kinds()

    def packed(partition: list, judged: bool) -> Iterator[tuple]:
        scanner = Scanner(known)
        for number, half, at in packs(partition):
            chosen = [partition[i] for i in at]
            docs = [(r.lang, r.text, r.good) for r in chosen]
            yield number, half, chosen, Pack(docs, table.value[:2], shards, scanner, judged, table.value[2])
            del chosen, docs
            give_back()

    def ask(index: int, partition: Iterator) -> Iterator[tuple]:
        partition = list(partition)
        # How many answers go back is not known here: a partition's rows are told on their own.
        if partition:
            yield 0, (index, len(partition))
        for number, half, _, pack in packed(partition, False):
            for shard, *ranges in pack.parts():
                yield shard, ((index, number, shard, pack.mark(ranges[-1])), half, pack.asked(*ranges))
            # Before the next one is made.
            del _, pack
        partition.clear()
        give_back()

    def answer(partition: Iterator) -> Iterator[tuple]:
        held = []
        for _, x in partition:
            if len(x) == 2:
                yield x[0], x[1:]
            else:
                held.append(x)
        if held:
            shard = Shard(held)
            # Counts of counts go to any partition.
            yield from ((0, x) for x in shard.counts())
            for (index, *pack), numbers in shard.answers():
                yield index, (*pack, numbers)
            del shard, pack, numbers
        del held
        give_back()

    asked = docs.mapPartitionsWithIndex(ask).partitionBy(shards, int)
    answers = asked.mapPartitions(answer).partitionBy(docs.getNumPartitions(), int)
    models: dict = {}
    for key, c in sc.runJob(answers, lambda got: [x for _, x in got if len(x) == 2], [0]):
        models[key] = added(models[key], c) if key in models else c

    def beside(partition: Iterator) -> Iterator[list | None]:
        """All answers of a partition beside its first row."""
        got = [x for _, x in partition if len(x) != 2]
        for rows in [x[0] for x in got if len(x) == 1]:
            yield [x for x in got if len(x) > 1]
            got = None
            yield from (None for _ in range(rows - 1))
        give_back()

    def judge(partition: Iterator) -> Iterator[tuple]:
        spell, held, by_pack = spellers(), [], defaultdict(list)
        for row, got in partition:
            held.append(row)
            for number, *answered in got or ():
                by_pack[number].append(answered)
        for number, half, chosen, pack in packed(held, True):
            logs, size = logs_of(pack, half, by_pack.pop(number, []), models, spell[1 - half])
            with np.errstate(over="ignore"):
                values = np.exp(-logs / np.maximum(size, 1)).tolist()
            for r, value, n in zip(chosen, values, size.tolist()):
                yield r.doc_id, r.lang, len(r.text), value if n else None
            # Before the next one is made.
            del chosen, pack, logs, size, values, r
        held.clear()
        give_back()

    more = answers.getNumPartitions() - docs.getNumPartitions()
    held: RDD = docs.union(sc.parallelize([], more)) if more > 0 else docs
    return spark.createDataFrame(held.zip(answers.mapPartitions(beside)).mapPartitions(judge), schema)


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
