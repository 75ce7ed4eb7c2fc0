"""Subject area of each document, by a distributed latent Dirichlet topic model of its sentences.

A document is a bag of sentences, each of which treats one topic; its topic
proportions are the shares of its sentences, with a Dirichlet prior.  A word of
a sentence comes from the topic or, as most words of any sentence, from the
background, which is how the whole corpus uses words: so words that stand
anywhere say nothing, in any language.

Texts are folded and split into sentences once, in chunks that hold each word of
theirs once.  The model is fitted to all documents: in each round of variational
EM the topics go to the tasks (topics x vocabulary, a bounded size), and the
tasks send back the expected counts of the words they hold, until the
likelihood rests.  The subjects' topics start from the labelled examples' words
and keep the words that stand mostly in documents whose other sentences treat
the subject too.  Further topics start after a few rounds from the sentences
that no other sentence of their document supports: they learn how whatever
treats no subject is worded, passing mentions and figures of speech included, in
the corpus's own languages, and compete for such sentences with the subjects.
A fitted topic is given to a subject by inspection of its top terms: the
subject under which the labelled examples use those terms, if one clearly leads.  A document treats the
subjects whose topics hold at least ``share`` of its sentences.

Words of fewer documents than ``MIN_DOCUMENTS`` or ``MIN_SHARE`` of all, whichever
is more, share ``RARE`` hashed numbers, so that the vocabulary is bounded
(by words in a document / ``MIN_SHARE``) and no word is left out.

Defined cases: null, empty and blank texts and texts without a sentence have no
subject; numbers and single letters aren't words; a document id that occurs
twice is assigned twice and reported once; a subject without examples can't be
found; other columns don't matter.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.textnorm import plain, split_words, words
from pairloom.session import arrow_fs, default_parallelism, materialise

#: Documents, and part of all documents, that must hold a word for a number of its own; numbers that the rarer words share.
MIN_DOCUMENTS, MIN_SHARE, RARE = 5, 1e-5, 1 << 14
#: Topics beside the subjects' own; rounds of EM at most; passes over a document in a round; relative gain in likelihood at which it rests.
OTHER_TOPICS, ROUNDS, PASSES, REST = 4, 40, 4, 2e-3
#: How much more often the examples of a subject must use a word than the corpus does, for it to be taken as the subject's.
LIFT = 3.0
#: Prior of a document's proportions, of a topic's words, and the part of a sentence's words that come from the background.
ALPHA, ETA, BACKGROUND = 0.3, 1e-3, 0.8
#: Part of a document's sentences that makes a subject.
SHARE = 0.2
#: Round after which the other topics start; part of a document's other sentences that supports a subject, and part of a word's uses in documents that support its subject.
OTHERS_AFTER, SUPPORT, KEEP = 3, 0.15, 0.6
#: Rounds in which words are kept for subjects or not.
SORTED_AFTER = 5
#: Words of a topic that are inspected, and how far the first subject must lead the second.
TOP_TERMS, LEAD = 60, 2.0
#: Words of letters that make a sentence.
SENTENCE_WORDS = 3
#: Documents of a chunk, and characters after which it ends.
CHUNK_DOCUMENTS, CHUNK_CHARS = 1000, 2_000_000
#: Chunks that are written, and so read again, at a time, however many a file holds.
GROUP_CHUNKS = 4
#: Words whose sums travel as one row.
BUCKET = 4096
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]*_]*\s+|(?<=[。！？])|[\r\n]+|\\r\\n|\\n|\\r")


def pieces(text: str | None) -> list[list[str]]:
    """Folded words of each piece of at least ``SENTENCE_WORDS`` words that the text's stops and line breaks cut off."""
    found = (split_words(piece) for piece in _SENTENCE.split(plain(text))) if text else ()
    return [w for w in found if len(w) >= SENTENCE_WORDS]


def sentences(text: str | None) -> list[list[str]]:
    """The pieces with at least ``SENTENCE_WORDS`` words of letters."""
    return [w for w in pieces(text) if sum(x.isalpha() for x in w) >= SENTENCE_WORDS]


def _digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: the recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        shift = np.where(small, shift - 1 / x, shift)
        x = np.where(small, x + 1, x)
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


@dataclass
class Corpus:
    """Documents as chunks (doc_ids, sentences of each, words of each sentence as places in ``numbers``)."""

    chunks: DataFrame
    vocabulary: dict[str, int]
    frequency: np.ndarray  # uses of each number in the corpus; the last RARE are the shared ones


@dataclass
class TopicModel:
    vocabulary: dict[str, int]
    frequency: np.ndarray
    topics: np.ndarray  # log of how much likelier a topic makes a word than the background does, words x topics
    subject_of: list[str | None]  # of each topic
    terms: list[list[str]]  # top terms of each topic
    rounds: int


def example_weights(examples: list[tuple[str, str]], vocabulary: dict[str, int], frequency: np.ndarray) -> dict[str, dict[str, float]]:
    """For each word the subjects whose examples use it clearly more often than the corpus, with their shares."""
    uses: dict[str, Counter] = defaultdict(Counter)
    size: Counter = Counter()
    for subject, text in examples:
        for w in words(text):
            if w in vocabulary:
                uses[w][subject] += 1
                size[subject] += 1
    corpus = frequency / max(frequency.sum(), 1)
    out = {}
    for w, by in uses.items():
        rate = {s: n / size[s] for s, n in by.items()}
        total = sum(rate.values())
        good = {s: r / total for s, r in rate.items() if r >= LIFT * corpus[vocabulary[w]]}
        if good:
            out[w] = good
    return out


def _numbers(found: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Number of each word; a rarer word has one of the shared numbers."""
    first = len(vocabulary)
    return np.array([k if (k := vocabulary.get(w)) is not None else first + zlib.crc32(w.encode()) % RARE for w in found], dtype=np.int32)


def _close(ids: list, per_doc: list[int], lengths: list[int], places: list[int], words_: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    """One chunk: pieces that are no sentences and words of one letter or of digits are taken out."""
    lengths, places = np.asarray(lengths, dtype=np.int64), np.asarray(places, dtype=np.int64)
    letters = np.array([w.isalpha() for w in words_], dtype=bool)
    counted = np.array([len(w) > 1 and not w.isdigit() for w in words_], dtype=bool)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    if len(lengths):
        good = np.add.reduceat(letters[places].astype(np.int64), np.cumsum(lengths) - lengths) >= SENTENCE_WORDS
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        kept = good[sentence] & counted[places]
        lengths = np.bincount(sentence[kept], minlength=len(lengths))[good]
        places, doc = places[kept], doc[good]
    used, places = np.unique(places, return_inverse=True)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(places, kind="stable")
    uses = np.bincount(places, minlength=len(used))
    # documents that hold each word: changes of document within a word's uses
    held = doc[owner[order]] if len(order) else np.zeros(0, np.int64)
    new = np.concatenate([[True], (held[1:] != held[:-1]) | (places[order][1:] != places[order][:-1])]) if len(order) else np.zeros(0, bool)
    holders = np.bincount(places[order][new], minlength=len(used))
    ints = lambda x: pa.array([np.asarray(x, dtype=np.int32)], pa.list_(pa.int32()))
    columns = [pa.array([ids], pa.list_(id_type)), ints(np.bincount(doc, minlength=len(per_doc))), ints(lengths), ints(places), ints(owner[order]), pa.array([[words_[k] for k in used]], pa.list_(pa.string())), ints(holders), ints(uses)]
    return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sentences", "lengths", "places", "owners", "words", "holders", "uses"])


def _chunks(documents: DataFrame) -> DataFrame:
    """Folded and split once: (doc_ids, sentences, lengths, places, owners, words, holders, uses).

    ``places`` are the words by sentence, ``owners`` the sentences by word: ``uses`` of them for each.
    """
    kind = documents.schema["doc_id"].dataType
    arrow_kind = documents.limit(0).select("doc_id").toArrow().schema.field(0).type

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple:
            known: defaultdict[str, int] = defaultdict()
            known.default_factory = known.__len__  # a new word gets the next number
            return [], [], [], [], known

        (ids, per_doc, lengths, places, known), size = empty(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = pieces(text)
                ids.append(doc)
                per_doc.append(len(got))
                for s in got:
                    lengths.append(len(s))
                    places.extend(map(known.__getitem__, s))
                size += len(text or "")
                if len(ids) >= CHUNK_DOCUMENTS or size >= CHUNK_CHARS:
                    yield _close(ids, per_doc, lengths, places, list(known), arrow_kind)
                    (ids, per_doc, lengths, places, known), size = empty(), 0
        if ids:
            yield _close(ids, per_doc, lengths, places, list(known), arrow_kind)

    schema = f"doc_ids array<{kind.simpleString()}>, sentences array<int>, lengths array<int>, places array<int>, owners array<int>, words array<string>, holders array<int>, uses array<int>"
    return _written(documents.select("doc_id", "text").mapInArrow(split, schema), "topic-chunks")


def _written(chunks: DataFrame, label: str) -> DataFrame:
    """Chunks in row groups of ``GROUP_CHUNKS``: a reader holds one group, whatever the size of the file."""
    return materialise(chunks, label, options={"parquet.block.row.count.limit": GROUP_CHUNKS})


def _files(chunks: DataFrame, columns: list[str], tasks: int | None = None) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """A row for each file of the chunks, in at most so many tasks, and what turns such rows into the chunks themselves, a row group at a time.

    Tasks read the files themselves: lists of numbers go a long way through rows, and Spark
    would put all chunks of a file into one batch.
    """
    import pyarrow.parquet as pq

    files = sorted(chunks.inputFiles())
    schema = chunks.select(*columns).limit(0).toArrow().schema

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for k in row.column(0).to_pylist():
                fs, path = arrow_fs(files[k])
                with fs.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(batch_size=GROUP_CHUNKS, columns=columns):
                        yield batch.select(columns).cast(schema)

    return chunks.sparkSession.range(0, len(files), 1, min(len(files), tasks or len(files)) or 1), read


def prepare(documents: DataFrame, vocabulary: dict[str, int] | None = None, frequency: np.ndarray | None = None) -> Corpus:
    """The documents' chunks with their words numbered, by the corpus's own vocabulary unless one is given."""
    spark = documents.sparkSession
    chunks = _chunks(documents)
    if vocabulary is None:
        size = chunks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
        entry = F.explode(F.arrays_zip("words", "holders", "uses")).alias("e")
        counts = chunks.select(entry).groupBy(F.col("e.words").alias("word")).agg(F.sum("e.holders").alias("n"), F.sum("e.uses").alias("uses"))
        counts = materialise(counts, "topic-words")
        least = max(MIN_DOCUMENTS, int(np.ceil(MIN_SHARE * size)))
        frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("word", ignore_index=True)
        vocabulary = {w: k for k, w in enumerate(frequent["word"])}
        frequency = np.concatenate([frequent["uses"].to_numpy(float), np.zeros(RARE)])
        rare = counts.filter(F.col("n") < least).groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(RARE)).cast("int").alias("at")).agg(F.sum("uses").alias("uses")).toPandas()
        frequency[len(vocabulary) + rare["at"].to_numpy(int)] = rare["uses"].to_numpy(float)
    shared = spark.sparkContext.broadcast(vocabulary)
    kept = ["doc_ids", "sentences", "lengths", "places", "owners", "uses"]
    files, read = _files(chunks, [*kept, "words"])

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(rows):
            numbers = pa.array([_numbers(w, shared.value) for w in batch.column("words").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], numbers], [*kept, "numbers"])

    ids = chunks.schema["doc_ids"].dataType.simpleString()
    numbered = files.mapInArrow(number, f"doc_ids {ids}, {', '.join(f'{c} array<int>' for c in kept[1:])}, numbers array<int>")
    return Corpus(_written(numbered, "topic-bags"), vocabulary, frequency)


def start_topics(vocabulary: dict[str, int], frequency: np.ndarray, weights: dict[str, dict[str, float]], subjects: list[str]) -> np.ndarray:
    """Counts, words x subjects, of the subjects' own words."""
    counts = np.zeros((len(frequency), len(subjects)))
    for w, by in weights.items():
        best = max(by, key=by.get)
        if by[best] >= 0.5:
            counts[vocabulary[w], subjects.index(best)] += frequency[vocabulary[w]] * by[best]
    return counts


def gains(counts: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Log of how much likelier each topic, mixed with the background, makes each word than the background alone."""
    background = (frequency + ETA) / (frequency + ETA).sum()
    rate = (counts + ETA * background[:, None]) / (counts.sum(0, keepdims=True) + ETA)
    return np.log(BACKGROUND + (1 - BACKGROUND) * rate / background[:, None]).astype(np.float32)


def fold_in(gain: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(topic of each sentence, proportions of each document, likelihood): sentences x topics; the last topic is the background.

    ``gain`` are the sentences' log-likelihoods, ``per_doc`` the sentences of each document that has any.
    """
    first = np.cumsum(per_doc) - per_doc
    gain = np.hstack([gain, np.zeros((len(gain), 1), gain.dtype)])
    top = gain.max(1, keepdims=True)
    like = np.exp(gain - top)
    k = gain.shape[1]
    gamma = ALPHA + np.repeat(per_doc[:, None] / k, k, axis=1)
    q = like
    for _ in range(PASSES):
        q = like * np.repeat(np.exp(_digamma(gamma)).astype(np.float32), per_doc, axis=0)
        q /= q.sum(1, keepdims=True)
        gamma = ALPHA + np.add.reduceat(q, first, axis=0)
    theta = np.repeat(gamma / gamma.sum(1, keepdims=True), per_doc, axis=0)
    return q, gamma, float((np.log((like * theta).sum(1)) + top[:, 0]).sum(dtype=float))


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_ids, sentences of each document, words of each sentence, words by sentence, sentences by word, uses of each word, numbers) of each chunk."""
    for row in range(batch.num_rows):
        yield batch.column("doc_ids")[row].values, *(batch.column(c)[row].values.to_numpy() for c in ("sentences", "lengths", "places", "owners", "uses", "numbers"))


def _sentence_gains(topics: np.ndarray, lengths: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Sum of the words' gains for each sentence (none for a sentence without words)."""
    out = np.zeros((len(lengths), topics.shape[1]), np.float32)
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = np.cumsum(lengths) - lengths
        out[filled] = np.add.reduceat(topics[numbers][places], starts[filled], axis=0)
    return out


def inspect(counts: np.ndarray, vocabulary: dict[str, int], weights: dict[str, dict[str, float]]) -> tuple[list[str | None], list[list[str]]]:
    """The subject of each topic by its top terms, or none; and those terms.

    Terms are ranked by how far the topic's rate exceeds the mean rate of the topics.
    """
    names = sorted(vocabulary, key=vocabulary.get)
    rate = (counts / np.maximum(counts.sum(0, keepdims=True), 1e-12))[: len(names)]
    lift = rate * np.log((rate + 1e-12) / (rate.mean(1, keepdims=True) + 1e-12))
    found, terms = [], []
    for k in range(counts.shape[1]):
        top = np.argsort(-lift[:, k])[:TOP_TERMS]
        votes: Counter = Counter()
        for at in top:
            for s, share in weights.get(names[at], {}).items():
                votes[s] += share * lift[at, k]
        ranked = votes.most_common(2)
        known = sum(lift[at, k] for at in top if names[at] in weights)
        clear = bool(ranked) and known >= 0.25 * lift[top, k].sum() and ranked[0][1] >= 0.4 * known and (len(ranked) < 2 or ranked[0][1] >= LEAD * ranked[1][1])
        found.append(ranked[0][0] if clear else None)
        terms.append([names[at] for at in top[:20]])
    return found, terms


def size_of(frequency: np.ndarray) -> int:
    """Buckets of words, and the likelihood's."""
    return -(-len(frequency) // BUCKET) + 1


def _buckets(held: np.ndarray, likelihood: float) -> pa.RecordBatch:
    """A task's sums as one row for each bucket of words that it holds, and the likelihood as bucket -1."""
    rows = [(-1, np.array([likelihood]).tobytes())]
    rows += [(k // BUCKET, part.tobytes()) for k in range(0, len(held), BUCKET) if (part := held[k : k + BUCKET]).any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["bucket", "data"])


def _add_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(data)
            held[k] = part + held[k] if k in held else part
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["bucket", "data"])


def _from_buckets(table: pa.Table, size: int, width: int) -> tuple[np.ndarray, float]:
    values, likelihood = np.zeros((size, width)), 0.0
    for k, data in zip(table["bucket"].to_pylist(), table["data"].to_pylist()):
        part = np.frombuffer(data)
        if k < 0:
            likelihood = float(part[0])
        else:
            values[k * BUCKET : (k + 1) * BUCKET] = part.reshape(-1, width)
    return values, likelihood


def fit(documents: DataFrame | Corpus, examples: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> TopicModel:
    """The topic model of all ``documents`` (doc_id, text)."""
    corpus = documents if isinstance(documents, Corpus) else prepare(documents)
    spark, vocabulary, frequency = corpus.chunks.sparkSession, corpus.vocabulary, corpus.frequency
    subjects = sorted({s for s, _ in examples})
    own = len(subjects)
    weights = example_weights(examples, vocabulary, frequency)
    counts = start_topics(vocabulary, frequency, weights, subjects)
    bags, read = _files(corpus.chunks, corpus.chunks.columns, 4 * spark.sparkContext.defaultParallelism)
    before, turn, rests = -np.inf, 0, not vocabulary
    parts = default_parallelism(spark)
    kept = np.ones((len(frequency), own), dtype=bool)
    while turn < rounds and not rests:
        turn += 1
        topics = gains(counts, frequency)
        shared = spark.sparkContext.broadcast(topics)
        # expected uses in the topics' sentences; while words are sorted out, uses in documents that support each subject and in unsupported sentences
        sorting = turn <= SORTED_AFTER
        names = [*[f"k{k}" for k in range(topics.shape[1])], *([*[f"d{k}" for k in range(own)], "unsupported"] if sorting else [])]

        def step(rows: Iterator[pa.RecordBatch], shared=shared, names=names, sorting=sorting) -> Iterator[pa.RecordBatch]:
            topics = shared.value
            held, likelihood = np.zeros((len(topics), len(names))), 0.0
            for batch in read(rows):
                for _, per_doc, lengths, places, owners, uses, numbers in _read(batch):
                    if not len(places):
                        continue
                    full = per_doc[per_doc > 0]
                    q, gamma, more = fold_in(_sentence_gains(topics, lengths, places, numbers), full)
                    likelihood += more
                    values = q[:, :-1]
                    if sorting:
                        others = np.repeat(gamma[:, :own] - ALPHA, full, axis=0) - q[:, :own]
                        supported = (others >= SUPPORT * np.repeat(full, full)[:, None]).astype(np.float32)
                        values = np.hstack([values, supported, 1 - (q[:, :own] * supported).sum(1, keepdims=True)])
                    # sums over the sentences of each word of the chunk; rare words may share a number
                    np.add.at(held, numbers, np.add.reduceat(values[owners], np.cumsum(uses) - uses, axis=0))
            yield _buckets(held, likelihood)

        # summed bucket by bucket: few rows of many numbers, so a task more adds little to the work of one
        sums = bags.mapInArrow(step, "bucket int, data binary").repartition(min(size_of(frequency), parts), "bucket").mapInArrow(_add_buckets, "bucket int, data binary")
        values, now = _from_buckets(sums.toArrow(), len(frequency), len(names))
        shared.unpersist()
        size = topics.shape[1]
        # of a word's uses in a topic's sentences, those that come from the topic and not from the background
        counts = values[:, :size] * (1 - BACKGROUND * np.exp(-topics.astype(float)))
        if sorting:
            kept = values[:, size:-1] >= KEEP * np.maximum(frequency, 1)[:, None]
        counts[:, :own] *= kept
        if turn == OTHERS_AFTER:
            start = (values[:, -1] ** 2 / np.maximum(frequency, 1))[:, None] * np.random.default_rng(seed).gamma(1.0, 1.0, (len(frequency), OTHER_TOPICS))
            start[kept.any(1)] = 0  # subjects' own words are open to the others, but don't start them
            counts = np.hstack([counts, start])
        rests = turn > OTHERS_AFTER + 2 and now - before <= REST * abs(now)
        before = now
    if not rests:
        warnings.warn(f"the topics' likelihood still grew after {rounds} rounds", stacklevel=2)
    subject_of, terms = inspect(counts, vocabulary, weights)
    return TopicModel(vocabulary, frequency, gains(counts, frequency), subject_of, terms, turn)


def assign(documents: DataFrame | Corpus, model: TopicModel, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, sentences, treated) of the subjects whose topics hold at least ``share`` of the sentences."""
    corpus = documents if isinstance(documents, Corpus) else prepare(documents, model.vocabulary, model.frequency)
    subjects = sorted({s for s in model.subject_of if s})
    kind = corpus.chunks.schema["doc_ids"].dataType.elementType.simpleString()
    shared = corpus.chunks.sparkSession.sparkContext.broadcast((model.topics, [subjects.index(s) if s in subjects else len(subjects) for s in model.subject_of]))

    files, read = _files(corpus.chunks, corpus.chunks.columns)

    def by_chunk(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, of = shared.value
        names = pa.array(subjects, pa.string())
        for batch in read(rows):
            for ids, per_doc, lengths, places, _, _, numbers in _read(batch):
                if not len(lengths):
                    continue
                full = np.flatnonzero(per_doc)
                q, _, _ = fold_in(_sentence_gains(topics, lengths, places, numbers), per_doc[full])
                mass = np.zeros((len(lengths), len(subjects) + 1))
                for k, at in enumerate([*of, len(subjects)]):
                    mass[:, at] += q[:, k]
                # a sentence goes to its likeliest subject or to none; the proportions are the shares of the sentences
                hard = np.zeros_like(mass)
                hard[np.arange(len(mass)), mass.argmax(1)] = 1
                treated = np.add.reduceat(hard[:, :-1], np.cumsum(per_doc[full]) - per_doc[full], axis=0)
                d, s = np.nonzero((treated >= share * per_doc[full][:, None] - 1e-9) & (treated > 0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(full[d])), names.take(pa.array(s)), pa.array(per_doc[full][d].astype(np.int64)), pa.array(treated[d, s].astype(np.int64))], ["doc_id", "subject", "sentences", "treated"])

    return files.mapInArrow(by_chunk, f"doc_id {kind}, subject string, sentences long, treated long")


def _examples(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """The labelled examples: a fixed, small table."""
    rows = spark.read.parquet(f"{sf}/subject_examples.parquet").dropna(subset=["subject", "text"]).orderBy("example_id")
    return [(r["subject"], r["text"]) for r in rows.select("subject", "text").toLocalIterator()]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    corpus = prepare(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return assign(corpus, fit(corpus, _examples(spark, sf))).select("doc_id", "subject").distinct()


def p9_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The topics' subjects and top terms, for inspection."""
    model = fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), _examples(spark, sf))
    rows = [(k, s, ", ".join(t)) for k, (s, t) in enumerate(zip(model.subject_of, model.terms))]
    return spark.createDataFrame(rows, "topic int, subject string, terms string")


QUERIES = {"p9_found": p9_found, "p9_topics": p9_topics}
SQL: dict[str, str] = {}
