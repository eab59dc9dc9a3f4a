"""Subject areas of documents.

Term weighting and truncated singular value decomposition: per language, terms are weighted by how much more often they meet within sentences
than chance has it, and the decomposition of these weights embeds them. A sentence is embedded as the weighted sum of its terms, the weight
of a term being the cube of its likeness to the nearest subject, so that words of no subject don't blur it. Centroids start from labelled
samples, the seeds, and from terms that none of these is like; they are refined iteratively, each taking the mean of its nearest terms, so
that words are reached that no sample shows. The samples then vote on what each centroid stands for. A sentence is about the subject whose
centroid has the highest cosine with it, if their product is large enough, and a document about the subjects of enough of its sentences.

All statistics (notices, term frequencies, associations) are counted over all distinct texts, in parallel; what reaches the driver
is bounded by the model's size: model_terms terms and their associations, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxmill.functions.ids import not_blank
from waxmill.session import materialize

#: Model size: the terms that occur in the most texts, of all languages.
MODEL_TERMS = 2048
#: Dimensions of a language's embedding: one for so many terms, at least two for each subject, at most so many.
TERMS_A_DIMENSION, DIMENSIONS = 12, 128
#: A term in a larger share of the texts carries no subject and isn't among the model's terms.
TOO_COMMON = 0.4
#: A line of at most so many words that recurs in this share of the texts (in three at least) is a notice or menu. Near copies count as one text.
NOTICE_WORDS, NOTICE_SHARE = 16, 0.002
#: Near copies agree in one of so many bands of so many smallest hashes of their word pairs, which about half the pairs in common makes likely.
BANDS, BAND_ROWS = 16, 4
#: Sentences: of at least so many words; text without punctuation is cut into sentences of about USUAL words once it is longer than LONGEST.
SHORTEST, USUAL, LONGEST = 3, 15, 40
#: Terms join a centroid of at least this similarity; a centroid of fewer terms that no seed started stands for nothing, one of a seed needs two.
SAME_CENTROID, LEAST_TERMS, LEAST_SEED_TERMS = 0.75, 4, 2
#: A word in more of the other subjects' samples than this is no seed of a subject.
SEED_OTHERS = 0.3
REFINEMENTS = 8
#: Similarity from which a term counts, and the sum of its terms' weighted similarities from which a sentence is about a subject.
TERM_COUNTS, SENTENCE_COUNTS = 0.4, 0.5
#: A centroid's subject: the share of its samples that hold the centroid's terms (three of them count in full), and how many times the other samples'
#: share that is; a centroid that this share of all samples of a language holds is about nothing; the likeness of words from which a
#: centroid without samples is named.
SEED_RATE, SEED_RATIO, SPREAD, LIKENESS = 0.4, 15, 0.15, 0.07
#: The share of sentences that makes a subject one of the document's.
SUBJECT_SHARE = 0.25
#: Markers among the words of an encoded text: a line that ends without or with the end of a sentence, and an end within a line.
LINE, LINE_END, END = 0, 1, 2

_TAG = re.compile(r"<[^<>]*>")
_ENDS = re.compile(r"[.!?]+[\"'”’»)\]]*$")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def word_of(token: str) -> str:
    """The word in a token: lower case, without markup, digits, a field name or an elided article."""
    token = _TAG.sub(" ", token.rpartition("=")[2])
    words = _WORD.findall(token.lower().replace("’", "'"))
    return max(words, key=len) if words else ""


def _code(word: str) -> int:
    return crc32(word.encode()) % (2**31 - 16) + 3


class Encoder:
    """Texts as arrays of word codes and markers."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, bool, bool]] = {}
        self.words: dict[int, str] = {}

    def _token(self, token: str) -> tuple[int, bool, bool]:
        found = self.known.get(token)
        if found is None:
            word = word_of(token)
            code = _code(word) if word else -1
            bare = _TAG.sub("", token)
            first = next((c for c in bare.rpartition("=")[2] if c.isalnum()), "")
            found = (code, bool(_ENDS.search(bare)), first.isupper())
            if word:
                self.words.setdefault(code, word)
                if len(self.known) < 1_000_000:
                    self.known[token] = found
        return found

    def encode(self, texts: pa.Array) -> pa.ListArray:
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        tokens = pc.utf8_split_whitespace(lines.flatten())
        line_sizes = np.diff(tokens.offsets.to_numpy())
        doc_of_line = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
        coded = tokens.flatten().dictionary_encode()
        table = np.array([self._token(t) for t in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 3)
        at = coded.indices.to_numpy()
        if not len(at):
            return pa.array([[] for _ in range(len(texts))], pa.list_(pa.int32()))
        # white space round a line gives empty tokens, which hold no word
        code, ends, upper = (table[at, k] for k in range(3))
        every_line = np.repeat(np.arange(len(line_sizes)), line_sizes)
        full = code >= 0
        # an end mark in a token without a word, such as a number or a bracket, counts for the word before it on the line
        before = np.cumsum(full) - 1
        stray = np.nonzero(~full & (ends > 0) & (before >= 0))[0]
        code, ends, upper, line = code[full], ends[full] > 0, upper[full], every_line[full]
        stray = stray[line[before[stray]] == every_line[stray]]
        ends[before[stray]] = True
        last = np.append(line[1:] != line[:-1], True) if len(line) else np.zeros(0, bool)
        next_upper = np.append(upper[1:] > 0, False) if len(line) else np.zeros(0, bool)
        # a number after a full stop belongs to the sentence: "pt. 2"
        followed = np.zeros(len(full), bool)
        followed[:-1] = ~full[1:]
        marker = np.where(last, np.where(ends, LINE_END, LINE), np.where(ends & next_upper & ~followed[full], END, -1))
        both = np.empty(2 * len(code), np.int64)
        both[0::2], both[1::2] = code, marker
        doc = np.repeat(doc_of_line[line], 2)
        keep = both >= 0
        sizes = np.bincount(doc[keep], minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(both[keep], pa.int32()))


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers in order, each once, how often each); by sorting, which is quicker here than hashing."""
    numbers = np.sort(numbers)
    starts = np.nonzero(np.append(True, numbers[1:] != numbers[:-1]))[0] if len(numbers) else np.zeros(0, np.int64)
    return numbers[starts], np.diff(np.append(starts, len(numbers)))


def _mix(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Lines:
    """The lines of encoded texts: the words with their lines and sentences, per sentence its end marker, and per line its text, end marker, words and hash."""

    words: np.ndarray
    line: np.ndarray
    sentence: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    marker: np.ndarray
    size: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, encoded: pa.ListArray) -> Lines:
        values, sizes = encoded.flatten().to_numpy().astype(np.int64), np.diff(encoded.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        is_word = values > END
        ends = values <= LINE_END
        line = np.cumsum(ends) - ends
        sentence = np.cumsum(~is_word) - ~is_word
        n = int(ends.sum())
        words, of = values[is_word], line[is_word]
        size = np.bincount(of, minlength=n)
        # the sum over a line's words, as a difference of running sums, which wrap round
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words), dtype=np.uint64)])
        end = np.cumsum(size)
        hashed = running[end] - running[end - size]
        return cls(words, of, sentence[is_word], values[~is_word], doc[ends], values[ends], size, hashed.view(np.int64))


def sentences(lines: Lines, notices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, their sentences from 0, the texts of the sentences), without notices, menus and headings."""
    n = len(lines.doc)
    own = ~(np.isin(lines.hash, notices) & (lines.size <= NOTICE_WORDS))
    texts = int(lines.doc.max()) + 1 if n else 0
    closes = np.bincount(lines.doc[own & (lines.marker == LINE_END)], minlength=texts) > 0
    # where a text has lines that end with a sentence, what stands at the end of another without its own end is a heading, if it is as short as one
    size = np.bincount(lines.sentence, minlength=len(lines.end))
    heading = (lines.end == LINE) & (size <= NOTICE_WORDS)
    kept = own[lines.line] & ~(heading[lines.sentence] & closes[lines.doc[lines.line]])
    words, sentence, doc = lines.words[kept], lines.sentence[kept], lines.doc[lines.line[kept]]
    if not len(words):
        return words, sentence, doc
    first = np.append(True, sentence[1:] != sentence[:-1])
    number = np.cumsum(first) - 1
    size = np.bincount(number)
    cuts = np.where(size > LONGEST, np.rint(size / USUAL), 1).astype(np.int64)
    part = (np.arange(len(words)) - np.nonzero(first)[0][number]) * cuts[number] // size[number]
    long_enough = (size >= SHORTEST)[number]
    words, number, part, doc = words[long_enough], number[long_enough], part[long_enough], doc[long_enough]
    if not len(words):
        return words, number, doc
    first = np.append(True, (number[1:] != number[:-1]) | (part[1:] != part[:-1]))
    return words, np.cumsum(first) - 1, doc[first]


class Places:
    """Places of words among the sorted terms, by a table without collisions where one is found."""

    SLOTS = 20

    def __init__(self, terms: np.ndarray):
        self.terms, self.table = terms, None
        for k in range(64 if len(terms) else 0):
            self.factor = np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            slots = self._slots(terms)
            if len(np.unique(slots)) == len(terms):
                self.table = np.zeros(1 << self.SLOTS, np.int32)
                self.table[slots] = np.arange(len(terms))
                break

    def _slots(self, words: np.ndarray) -> np.ndarray:
        return (words.astype(np.uint64) * self.factor >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words are terms, the places of those)."""
        if self.table is not None:
            place = self.table[self._slots(words)]
        elif len(self.terms):
            place = np.searchsorted(self.terms, words)
            place[place == len(self.terms)] = 0
        else:
            return np.zeros(len(words), bool), np.zeros(0, np.int64)
        known = self.terms[place] == words
        return known, place[known].astype(np.int64)


def encode_texts(texts: DataFrame) -> DataFrame:
    """texts (digest, text) as a written table (digest, codes, words): a row per text; and, where digest is null, the words of the codes met by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        names = ["digest", "codes", "words"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = encoder.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), codes, pa.nulls(part.num_rows, pa.list_(pa.string()))], names=names)
        if encoder.words:
            codes, words = list(encoder.words), list(encoder.words.values())
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([codes], pa.list_(pa.int32())), pa.array([words], pa.list_(pa.string()))], names=names)

    return materialize(texts.select("digest", "text").mapInArrow(run, "digest string, codes array<int>, words array<string>"), "encoded")


def near_copy_bands(lines: Lines, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(those of the texts `among` that have words, BANDS hashes of each): of two texts with most word pairs in common some band is equal."""
    doc = lines.doc[lines.line]
    wanted = np.isin(doc, among)
    doc = doc[wanted]
    if not len(doc):
        return doc, np.zeros((0, BANDS), np.int64)
    mixed = _mix(lines.words[wanted])
    pairs = mixed.copy()
    pairs[:-1] += np.where(doc[1:] == doc[:-1], mixed[1:] * np.uint64(3), np.uint64(0))
    starts = np.nonzero(np.append(True, doc[1:] != doc[:-1]))[0]
    bands = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * BAND_ROWS):
        least = np.minimum.reduceat(_mix(pairs ^ _mix(np.array([k + 1]))), starts)
        bands[:, k // BAND_ROWS] = _mix(bands[:, k // BAND_ROWS] + least)
    return doc[starts], bands.view(np.int64)


def notices_of(encoded: DataFrame, recurring: np.ndarray, least: float) -> list[int]:
    """Those of the sorted hashes of recurring lines that at least `least` texts hold when near copies count as one: they are what else is different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, lines = part.column(0).to_numpy(), Lines.of(part.column(1))
                held = (lines.size <= NOTICE_WORDS) & (lines.size > 0) & np.isin(lines.hash, recurring)
                texts, bands = near_copy_bands(lines, lines.doc[held])
                # band -1: the lines of a text
                columns = [np.append(np.repeat(ids[texts], BANDS), ids[lines.doc[held]]), np.append(np.tile(np.arange(BANDS), len(texts)), np.full(int(held.sum()), -1)), np.append(bands.ravel(), lines.hash[held])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=["text", "band", "hash"])

    rows = materialize(encoded.select(F.xxhash64("digest").alias("text"), "codes").mapInArrow(run, "text long, band long, hash long"), "bands")
    bands = rows.filter("band >= 0")
    first = bands.groupBy("band", "hash").agg(F.min("text").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = bands.join(first, ["band", "hash"]).groupBy("text").agg(F.min("first").alias("cluster"))
    held = rows.filter("band < 0").select("text", "hash").distinct().join(copies, "text", "left").select("hash", F.coalesce("cluster", "text").alias("cluster"))
    counted = held.distinct().groupBy("hash").agg(F.count("*").alias("n"))
    return [r["hash"] for r in counted.filter(F.col("n") >= least).collect()]


def count_lines_and_words(encoded: DataFrame, model_terms: int = MODEL_TERMS) -> tuple[list[int], dict[int, int], int]:
    """(hashes of notices, texts by word code of the model's terms, number of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "n"]
        total, words = 0, np.zeros((0, 2), np.int64)

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=names)

        def merged(pairs: np.ndarray) -> np.ndarray:
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            keys, n = _distinct(pairs[:, 0])
            return np.stack([keys, np.add.reduceat(pairs[:, 1], np.cumsum(n) - n) if len(n) else n], 1)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(at, 2000)
                lines = Lines.of(part)
                total += len(part)
                short = (lines.size <= NOTICE_WORDS) & (lines.size > 0)
                # once per text
                of, hashed = lines.doc[short], lines.hash[short]
                order = np.lexsort((hashed, of))
                of, hashed = of[order], hashed[order]
                new = np.append(True, (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1]))[: len(of)]
                yield rows(1, *_distinct(hashed[new]))
                doc_word, _ = _distinct(lines.doc[lines.line] << 32 | lines.words)
                words = np.concatenate([words, np.stack(_distinct(doc_word & 0xFFFFFFFF), 1)])
                if len(words) > 500_000:
                    words = merged(words)
        words = merged(words)
        yield rows(2, words[:, 0], words[:, 1])
        yield rows(0, np.zeros(1, np.int64), np.array([total]))

    counted = encoded.select("codes").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter("kind <> 1 or n > 2"), "counts")
    total = counted.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    # at most (lines of a text) / NOTICE_SHARE hashes
    least = max(3, NOTICE_SHARE * total)
    recurring = [r["key"] for r in counted.filter((F.col("kind") == 1) & (F.col("n") >= least)).collect()]
    notices = notices_of(encoded, np.array(sorted(recurring), np.int64), least) if recurring else []
    terms = counted.filter((F.col("kind") == 2) & (F.col("n") >= 3) & (F.col("n") <= max(3, TOO_COMMON * total))).orderBy(F.desc("n"), "key").limit(model_terms)
    return notices, {r["key"]: r["n"] for r in terms.collect()}, total


def count_associations(encoded: DataFrame, terms: np.ndarray, notices: np.ndarray) -> tuple[np.ndarray, int]:
    """(in how many sentences each two of the sorted term codes meet, number of sentences)."""
    v = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total, waiting, held = np.zeros(v * v, np.int32), 0, [], 0
        places = Places(terms)

        def settle() -> None:
            nonlocal held
            if waiting:
                sums[:] += np.bincount(np.concatenate(waiting), minlength=v * v).astype(np.int32)
                waiting.clear()
                held = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                words, sentence, _ = sentences(Lines.of(batch.column(0).slice(at, 2000)), notices)
                if not len(words):
                    continue
                total += int(sentence[-1]) + 1
                known, place = places.find(words)
                unique, _ = _distinct(sentence[known] * v + place)
                of = unique // v
                term = (unique - of * v).astype(np.int32)
                starts = np.nonzero(np.append(True, of[1:] != of[:-1]))[0] if len(of) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, len(of)))
                for size in np.unique(sizes):
                    block = np.ascontiguousarray(term[starts[sizes == size][:, None] + np.arange(size)].T)
                    # terms are in order within a sentence
                    for i in range(size):
                        waiting.append((block[i] * np.int32(v) + block[i:]).ravel())
                        held += waiting[-1].size
                if held > 4_000_000:
                    settle()
        settle()
        found = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(sums[found], total), pa.int64())], names=["pair", "n"])

    rows = encoded.select("codes").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # at most model_terms**2 / 2 numbers
    got = rows.toArrow()
    pair, n = got.column("pair").to_numpy(), got.column("n").to_numpy()
    met = np.zeros(v * v)
    met[pair[pair >= 0]] = n[pair >= 0]
    met = met.reshape(v, v)
    return met + np.triu(met, 1).T, int(n[pair < 0].sum())


def embed_terms(met: np.ndarray, n_sentences: int, least: int) -> np.ndarray:
    """Unit vectors of the terms: truncated singular value decomposition of the weighted associations, by subspace iteration."""
    df = np.diag(met).copy()
    chance = np.outer(df, df) / max(1, n_sentences)
    weighted = np.log1p(np.maximum(0, (met - chance) / np.sqrt(chance + 1)))
    np.fill_diagonal(weighted, 0)
    # a smaller vocabulary has fewer directions that aren't noise
    k = min(len(df), DIMENSIONS, max(least, len(df) // TERMS_A_DIMENSION))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((len(df), min(len(df), k + 16))))[0]
    for _ in range(6):
        basis = np.linalg.qr(weighted @ basis)[0]
    values, within = np.linalg.eigh(basis.T @ weighted @ basis)
    best = np.argsort(-np.abs(values))[:k]
    vectors = (basis @ within[:, best]) * np.sqrt(np.abs(values[best]))
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def seed_centroids(vectors: np.ndarray, held: list[tuple[set[int], str]], subjects: list[str], neutral: str) -> np.ndarray:
    """A centroid for each subject with samples (the terms they hold, subject): the sum of its terms by how much more often its samples hold them than others do."""
    shown = np.zeros((len(held), len(vectors)))
    for row, (terms, _) in enumerate(held):
        shown[row, list(terms)] = 1
    subject = np.array([s for _, s in held])
    seeds = []
    for s in subjects:
        mine = subject == s
        if s == neutral or not mine.any():
            continue
        inside, outside = shown[mine].mean(0), (shown[~mine].sum(0) + 0.5) / ((~mine).sum() + 1)
        weight = np.where((inside > 0) & (outside <= SEED_OTHERS), inside * np.maximum(0, np.log(np.maximum(inside, 1e-9) / outside)), 0)
        seed = weight @ vectors
        if np.linalg.norm(seed) > 0:
            seeds.append(seed / np.linalg.norm(seed))
    return np.array(seeds).reshape(-1, vectors.shape[1])


def refine_centroids(vectors: np.ndarray, weights: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Centroids of the terms: the seeds, then the heaviest terms that are like none so far, start them; each takes the mean of its nearest terms until REFINEMENTS are made."""
    centroids, seeded = seeds, np.ones(len(seeds), bool)
    for i in np.argsort(-weights, kind="stable"):
        if not len(centroids) or (centroids @ vectors[i]).max() < SAME_CENTROID:
            centroids, seeded = np.vstack([centroids, vectors[i]]), np.append(seeded, False)
    for _ in range(REFINEMENTS):
        near = vectors @ centroids.T
        nearest, best = near.argmax(1), near.max(1)
        member = best >= SAME_CENTROID
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest[member], np.log1p(weights[member])[:, None] * vectors[member])
        sizes = np.bincount(nearest[member], minlength=len(centroids))
        centroids = np.where((sizes > 0)[:, None], sums, centroids)
        kept = (sizes >= LEAST_TERMS) | seeded
        centroids, seeded, sizes = centroids[kept], seeded[kept], sizes[kept]
        if not len(centroids):
            break
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
        # centroids that have met are one
        apart: list[int] = []
        for i in np.lexsort((-sizes, ~seeded)):
            if all(centroids[i] @ centroids[j] < SAME_CENTROID for j in apart):
                apart.append(i)
        centroids, seeded = centroids[apart], seeded[apart]
    return centroids


def _grams(words: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for w in words:
        for i in range(len(w) - 1):
            g = f"^{w}"[i : i + 4]
            out[g] = out.get(g, 0) + 1 / len(w)
    return out


def _alike(a: dict[str, float], b: dict[str, float]) -> float:
    norm = lambda x: sum(v * v for v in x.values()) ** 0.5 or 1.0
    return sum(v * b.get(g, 0.0) for g, v in a.items()) / norm(a) / norm(b)


def term_languages(met: np.ndarray, held: list[tuple[set[int], str, str]], tongues: list[str]) -> np.ndarray:
    """Per term and language how much of what the term meets in sentences is of that language, by the samples' words."""
    seen = np.zeros((len(met), len(tongues)))
    for terms, tongue, _ in held:
        seen[list(terms), tongues.index(tongue)] += 1
    rate = seen / np.maximum(1, [sum(t == x for _, x, _ in held) for t in tongues])
    of_language = rate / np.maximum(rate.sum(1, keepdims=True), 1e-9)
    # words that several languages share tell nothing
    return (met / np.maximum(np.diag(met), 1)[:, None]) @ np.where(of_language >= 0.9, of_language, 0)


def label_centroids(members: list[np.ndarray], held: list[tuple[set[int], str, str]], languages: np.ndarray, tongues: list[str], words: list[str], subjects: list[str], neutral: str) -> list[str]:
    """The subject each centroid stands for, the empty string where it stands for none.

    members: each centroid's terms; held: of every labelled sample the terms, language and subject; languages: see term_languages. A
    centroid stands for the subject whose samples in its language hold its terms far more often than others do; the
    neutral subject's terms occur with all others and need no centroid. Subjects without (or with but one) sample in a language, and without
    a centroid there, get the centroids that no sample knows, by the likeness of their words to those of the subject in other languages.
    """
    labels: list[str | None] = []
    size = {(t, s): sum(1 for _, t2, s2 in held if (t, s) == (t2, s2)) for t in tongues for s in subjects}
    language = [tongues[int(languages[m].sum(0).argmax())] for m in members]
    for terms, tongue in zip(members, language, strict=True):
        mine = set(terms.tolist())
        by = dict.fromkeys(subjects, 0.0)
        for h, t, s in held:
            if t == tongue:
                by[s] += min(len(mine & h), 3) / 3
        rate = {s: by[s] / size[tongue, s] for s in subjects if size[tongue, s]}
        best = max(rate, key=lambda s: rate[s])
        # one sample may bear a wrong label
        others = max(0.0, sum(by.values()) - by[best] - 1) / max(1, sum(size[tongue, s] for s in subjects) - size[tongue, best])
        known = rate[best] >= SEED_RATE and rate[best] > SEED_RATIO * others
        spread = sum(by.values()) / sum(size[tongue, s] for s in subjects)
        labels.append((best if best != neutral else "") if known else "" if spread >= SPREAD else None)
    grams = {s: _grams([words[i] for m, label in zip(members, labels, strict=True) if label == s for i in m]) for s in subjects if s != neutral and s in labels}
    named = {(t, label) for t, label in zip(language, labels, strict=True) if label}
    for c, label in enumerate(labels):
        if label is None:
            mine = _grams([words[i] for i in members[c]])
            scores = sorted(((_alike(mine, g), s) for s, g in grams.items()), reverse=True)
            fits = bool(scores) and scores[0][0] >= LIKENESS and (len(scores) < 2 or scores[0][0] >= 1.5 * scores[1][0])
            fits = fits and size[language[c], scores[0][1]] <= 1 and (language[c], scores[0][1]) not in named
            labels[c] = scores[0][1] if fits else ""
    return labels


@dataclass
class SubjectModel:
    """terms: sorted codes of those that tell a subject; affinity: per such term and subject the weighted similarity; notices: hashes of lines."""

    subjects: list[str]
    neutral: str
    terms: np.ndarray
    affinity: np.ndarray
    notices: np.ndarray
    words: list[str]
    labels: list[tuple[str, list[str]]]

    def share(self, encoded: pa.ListArray, places: Places) -> tuple[np.ndarray, np.ndarray]:
        """(sentences about each subject, all sentences) of each encoded text; places: those of the model's terms."""
        words, sentence, doc = sentences(Lines.of(encoded), self.notices)
        counts, total = np.zeros((len(encoded), len(self.subjects))), np.bincount(doc, minlength=len(encoded)) if len(words) else np.zeros(len(encoded))
        known, place = places.find(words) if len(words) else (np.zeros(0, bool), np.zeros(0, np.int64))
        if len(place):
            once, _ = _distinct(sentence[known] * len(self.terms) + place)
            of, place = once // len(self.terms), once % len(self.terms)
            starts = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
            scores = np.add.reduceat(self.affinity[place], starts, axis=0)
            about = scores.max(1) >= SENTENCE_COUNTS
            np.add.at(counts, (doc[of[starts[about]]], scores[about].argmax(1)), 1)
        return counts, total


def fit(encoded: DataFrame, samples: list[tuple[str, str, str]], subjects: list[str], neutral: str, model_terms: int = MODEL_TERMS) -> SubjectModel:
    """The model of a corpus (encoded, one row per distinct text). samples: labelled texts (text, language, subject), of which there may be some thousands at most; labels that aren't subjects are passed over."""
    texts = encoded.filter("digest is not null")
    notices, df, _ = count_lines_and_words(texts, model_terms)
    terms = np.array(sorted(df), dtype=np.int64)
    notices = np.array(sorted(notices), dtype=np.int64)
    empty = SubjectModel(subjects, neutral, terms[:0], np.zeros((0, len(subjects))), notices, [], [])
    coded = Encoder().encode(pa.array([s[0] for s in samples], pa.string()))
    place = {int(t): i for i, t in enumerate(terms)}
    held = [({place[c] for c in codes if c in place}, t or "", s) for codes, (_, t, s) in zip(coded.to_pylist(), samples, strict=True) if s in subjects]
    if len(terms) < LEAST_TERMS or not held:
        return empty
    dictionary = encoded.filter("digest is null").select(F.explode(F.arrays_zip("codes", "words")).alias("x")).select("x.codes", "x.words")
    wanted = F.broadcast(encoded.sparkSession.createDataFrame([(int(t),) for t in terms], "codes int"))
    names = {r["codes"]: r["w"] for r in dictionary.join(wanted, "codes").groupBy("codes").agg(F.min("words").alias("w")).collect()}
    words = [names.get(int(t), "") for t in terms]
    met, n = count_associations(texts, terms, notices)

    tongues = sorted({t for _, t, _ in held})
    spoken = term_languages(met, held, tongues)
    frequency = np.diag(met)
    members: list[np.ndarray] = []
    likeness: list[np.ndarray] = []
    for k, tongue in enumerate(tongues):
        mine = np.nonzero((spoken.argmax(1) == k) & (spoken.max(1) > 0))[0]
        if len(mine) < LEAST_TERMS:
            continue
        at = {int(i): j for j, i in enumerate(mine)}
        vectors = embed_terms(met[np.ix_(mine, mine)], int(n * frequency[mine].sum() / max(1.0, frequency.sum())), 2 * len(subjects) + 2)
        shown = [({at[i] for i in h if i in at}, s) for h, t, s in held if t == tongue]
        centroids = refine_centroids(vectors, frequency[mine], seed_centroids(vectors, shown, subjects, neutral))
        near = vectors @ centroids.T
        for c in range(len(centroids)):
            joined = np.nonzero((near.argmax(1) == c) & (near[:, c] >= SAME_CENTROID))[0]
            if len(joined) >= LEAST_SEED_TERMS:
                members.append(mine[joined])
                likeness.append(np.zeros(len(terms)))
                likeness[-1][mine] = near[:, c]
    if not members:
        return empty
    labels = label_centroids(members, held, spoken, tongues, words, subjects, neutral)
    affinity = np.zeros((len(terms), len(subjects)))
    for near, label in zip(likeness, labels, strict=True):
        if label:
            s = subjects.index(label)
            affinity[:, s] = np.maximum(affinity[:, s], near)
    # weight and likeness at once: summed over a sentence's terms they are the product of its embedding and the centroids
    most = affinity.max(1, keepdims=True)
    affinity = np.where(most >= TERM_COUNTS, most**3 * np.maximum(affinity, 0), 0)
    telling = affinity.max(1) > 0
    return SubjectModel(subjects, neutral, terms[telling], affinity[telling], notices, words, [(label, [words[i] for i in m]) for label, m in zip(labels, members, strict=True)])


def subject_areas(docs: DataFrame, id: str, text: str, samples: list[tuple[str, str, str]], subjects: list[str], neutral: str, model_terms: int = MODEL_TERMS) -> DataFrame:
    """id, subject, share: the subject areas of every document, with the share of its sentences about each.

    A subject is an area of a document if at least SUBJECT_SHARE of its sentences are about it, notices, menus and headings apart; the
    neutral subject (what all documents are about: the music itself) only if no other is and that share of its sentences is about nothing else. Null
    and blank texts, and texts without a sentence, have none. Copies of a text have the same areas; rows with a null id are
    left out; an empty table gives an empty result; other columns are ignored.
    """
    keyed = docs.select(F.col(id).alias("id"), F.md5(F.col(text)).alias("digest"), F.col(text).alias("text")).filter(not_blank("text"))
    encoded = encode_texts(keyed.select("digest", "text").dropDuplicates(["digest"]))
    model = fit(encoded, samples, subjects, neutral, model_terms)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(model.terms)
        for batch in frames:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts, total = model.share(part.column(1), places)
                shares = counts / np.maximum(total, 1)[:, None]
                rest = 1 - shares.sum(1)
                area = shares >= SUBJECT_SHARE - 1e-9
                lone = subjects.index(neutral)
                area[:, lone] = (area.sum(1) - area[:, lone] == 0) & (total > 0) & (rest + shares[:, lone] >= SUBJECT_SHARE - 1e-9)
                shares[:, lone] += rest
                row, s = np.nonzero(area)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([subjects[k] for k in s], pa.string()), pa.array(shares[row, s], pa.float64())], names=["digest", "subject", "share"])

    found = encoded.filter("digest is not null").select("digest", "codes").mapInArrow(run, "digest string, subject string, share double")
    return keyed.select("id", "digest").filter(F.col("id").isNotNull()).join(found, "digest").select(F.col("id").alias(id), "subject", "share").distinct()
