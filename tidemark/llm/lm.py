"""Language-model scoring: a trigram model in Elias-Fano tries, one per shard of contexts.

    P(w | u, v) = (c(u, v, w) + NU * P(w | v)) / (c(u, v) + NU)
    P(w | v)    = (c(v, w) + MU * P(w)) / (c(v) + MU),   P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Each sums to one. A document's first word has the pair's probability. Tries hold, quantised, what the
sequences seen in training add to the probability of the shorter one: c(v, w) / (c(v) + MU) in tries of
two levels, c(u, v, w) / (c(u, v) + NU) in tries of three; the rest is the weight of backing off. In
the latter c(u, v) is the count read back from the quantised pair, which is exact where it is small.

Documents are cut into blocks of bounded size, numbered words in files in the shared folder. A block
asks for the counts and numbers of its distinct words, then for its distinct pairs, then for its
distinct triples, and is answered by the shard that gathers them from all blocks: counts, builds its
trie, writes it and looks up what was asked. So no table of all words or sequences is ever in one place,
and a frequent word costs a row per block. What follows a frequent word or pair is dealt to as many
shards as its count asks for. Words that training lacks have no number, and nothing asks for sequences
with them, nor for triples that begin with an unseen pair: their counts are zero.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import written
from tidemark.llm.elias_fano import Sequence, Trie
from tidemark.llm.filesets import FileSet
from tidemark.session import work_folder

ORDER = 3
MU = 1000.0
NU = 10.0
BLOCK_BYTES = 32 << 20  # of text
WORDS_PER_SHARD = 1 << 20  # that blocks ask of one shard, about
PAIRS_PER_SHARD = 3 << 20  # pairs or triples
HOT = 200_000  # occurrences of a word or pair for which what follows it gets one more shard
SEED = 5
END = b""  # ends each document, and is what stands before its first word

_ANSWERS = "block string, kind int, shard int, data binary, book binary"


def held_out(remainder: int = 1, modulus: int = 5) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id counts as an empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus == remainder


class _Numbers(dict):
    """Words to numbers, in the order of their first use; the end is 0."""

    def __init__(self) -> None:
        super().__init__()
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Some documents as numbers of words."""

    def __init__(self, doc_ids, held, lengths, ids, words, trained) -> None:
        self.doc_ids, self.held, self.lengths = doc_ids, held, lengths
        self.ids, self.words, self.trained = ids, words, trained

    def to_bytes(self) -> bytes:
        whole = {
            "doc_ids": pa.array([self.doc_ids], pa.list_(self.doc_ids.type)),
            "held": pa.array([self.held], pa.list_(pa.bool_())),
            **{n: [getattr(self, n).tobytes()] for n in ("lengths", "ids", "words", "trained")},
        }
        out, table = io.BytesIO(), pa.table(whole)
        with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(table)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> _Block:
        row = pa.ipc.open_file(data).read_all()
        numbers = lambda n, kind: np.frombuffer(row[n][0].as_buffer(), kind)
        return cls(
            row["doc_ids"][0].values,
            np.array(row["held"][0].values),
            numbers("lengths", "<u4"),
            numbers("ids", "<u4"),
            numbers("words", "<u8"),
            numbers("trained", "<u8"),
        )

    def by_word_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers ordered by shard, and where each shard begins."""
        shard = (self.words >> np.uint64(20)) % np.uint64(shards)
        order = np.lexsort((self.words, shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def pairs(self):
        """The distinct pairs (before, word), and for each position its pair's place among them."""
        before = np.concatenate([[np.uint32(self.end)], self.ids[:-1]])
        return _distinct(before, self.ids)

    @property
    def end(self) -> int:
        return int(self.ids[-1])

    def later(self) -> np.ndarray:
        """Whether a position has a word of its document before it."""
        found = np.ones(len(self.ids), bool)
        found[np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)[:-1]])] = False
        return found

    def learned(self) -> np.ndarray:
        """Whether a position is in the training part."""
        return np.repeat(~self.held, self.lengths)

    def triples(self, inverse: np.ndarray, later: np.ndarray):
        """The distinct triples as (pair's place, word), and for each later position its triple's place."""
        at = np.flatnonzero(later)
        return _distinct(inverse[at - 1], self.ids[at])


def _distinct(first: np.ndarray, second: np.ndarray):
    """The distinct pairs of numbers in order, and for each row its pair's place; a block has fewer
    words than 32 bits hold."""
    key = (first.astype(np.uint64) << np.uint64(32)) | second
    key, place = np.unique(key, return_inverse=True)
    return (key >> np.uint64(32)).astype(np.int32), key.astype(np.uint32).view(np.int32), place.astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _dealt(shards: int, hashes: np.ndarray, first: np.ndarray, *below: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """The order of sequences by shard, and where each shard begins.

    The shard is that of the first word's hash, moved by the hash of each next word within the number
    of parts that the count of what stands before it asks for. ``below`` has for each next word its
    place, what stands before it and the counts of those.
    """
    mixed = hashes[first] >> np.uint64(7)
    for turn, (word, before, counts) in enumerate(below):
        parts = (counts // np.uint64(HOT) + np.uint64(1))[before]
        part = (hashes >> np.uint64(9 + 2 * turn))[word]
        part %= parts
        part *= np.uint64(0x9E3779B1 + 2 * turn)
        mixed += part
    mixed %= np.uint64(shards)
    shard = mixed.astype(np.int32)
    del mixed
    order = np.argsort(shard, kind="stable").astype(np.int32)
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


class _Known:
    """A block with what the answers so far say: counts and numbers of words, then the pairs' shares."""

    def __init__(self, path: str, answers: pa.Table, word_shards: int, shards: int, mu: float) -> None:
        self.block = block = _open(path, answers["block"][0].as_py())
        order, begins = block.by_word_shard(word_shards)
        self.counts, self.numbers = np.zeros(len(order), "<u8"), np.zeros(len(order), "<u8")
        data = _by_shard(answers, 0)
        for shard, (a, b) in enumerate(zip(begins, begins[1:])):
            if a < b:
                both = _unpacked(data[shard][0], "<u8")
                self.counts[order[a:b]], self.numbers[order[a:b]] = both[: b - a], both[b - a :]
        self.before, self.word, self.inverse = block.pairs()
        # Only pairs of known words are asked for.
        known = self.numbers > 0
        self.asked = np.flatnonzero(known[self.before] & known[self.word]).astype(np.int32)
        before, word = self.before[self.asked], self.word[self.asked]
        self.dealt, self.begins = _dealt(shards, block.words, before, (word, before, self.counts))
        self.shares = _read(answers, 1, len(self.before), self.asked[self.dealt], self.begins)
        contexts = self.counts[self.before].astype(np.float64)
        #: How often a pair was seen, as far as its quantised share tells.
        self.pair_counts = np.rint(self.shares * (contexts + mu)).astype("<u8")
        self.pair_counts[(self.shares > 0) & (self.pair_counts == 0)] = 1

    def triples(self, shards: int):
        """The distinct triples, those asked for in the shards' order, where each shard begins, and for
        each later position its triple's place."""
        block = self.block
        pair, word, place = block.triples(self.inverse, block.later())
        asked = np.flatnonzero((self.pair_counts > 0)[pair] & (self.numbers > 0)[word]).astype(np.int32)
        p, w = pair[asked], word[asked]
        u, v = self.before[p], self.word[p]
        order, begins = _dealt(shards, block.words, u, (v, u, self.counts), (w, p, self.pair_counts))
        return pair, word, asked[order], begins, place


def _read(answers: pa.Table, kind: int, size: int, asked: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The shares that the shards answered, at the places asked for; zero elsewhere."""
    shares, data = np.zeros(size), _by_shard(answers, kind)
    for shard, (a, b) in enumerate(zip(begins, begins[1:])):
        if a < b and shard in data:
            codes, book = data[shard]
            shares[asked[a:b]] = np.frombuffer(book, "<f4")[_unpacked(codes, "u1")]
    return shares


def blocks(docs: DataFrame, held: Column, path: str) -> DataFrame:
    """Cut ``docs`` into block files at ``path``; returns block, n_tokens, n_words of each.

    Words are split by ASCII white space, A-Z lower-cased; each document has an end after its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSet(path)
        numbers, ids, lengths, doc_ids, held_rows, size = _Numbers(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            flat, held_all = np.concatenate(ids), np.concatenate(held_rows)
            # Frequent words get small numbers, which compress well.
            often = np.bincount(flat, minlength=len(numbers))
            order = np.argsort(-often, kind="stable")
            renumbered = np.empty(len(order), np.uint32)
            renumbered[order] = np.arange(len(order), dtype=np.uint32)
            flat = renumbered[flat]
            sizes = np.array(lengths, np.uint32)
            learned = flat[np.repeat(~held_all, sizes)]
            digest, names = xxhash.xxh64_intdigest, list(numbers)
            words = np.fromiter((digest(names[i], SEED) for i in order), np.uint64, len(order))
            trained = np.bincount(learned, minlength=len(order)).astype(np.uint64)
            block = _Block(pa.concat_arrays(doc_ids), held_all, sizes, flat, words, trained)
            name, stream = files.create(".block")
            with stream:
                stream.write(block.to_bytes())
            return pa.RecordBatch.from_pylist(
                [{"block": name, "n_tokens": len(flat), "n_words": len(order)}], schema=meta
            )

        for batch in batches:
            texts, marks = batch.column(1), np.array(batch.column(2))
            at = 0
            for i, text in enumerate(texts):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = raw.lower().split()
                words.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
                size += len(raw) + 64
                if size >= BLOCK_BYTES:
                    doc_ids.append(batch.column(0).slice(at, i + 1 - at))
                    held_rows.append(marks[at : i + 1])
                    at = i + 1
                    yield close()
                    numbers, ids, lengths, doc_ids, held_rows, size = _Numbers(), [], [], [], [], 0
            if at < batch.num_rows:
                doc_ids.append(batch.column(0).slice(at))
                held_rows.append(marks[at:])
        if lengths:
            yield close()

    meta = pa.schema([("block", pa.string()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])
    made = docs.select("doc_id", "text", held.alias("held")).mapInArrow(
        run, "block string, n_tokens long, n_words long"
    )
    return written(made, "lm-blocks")


def _open(path: str, name: str) -> _Block:
    return _Block.from_bytes(FileSet(path).get(name))


def _asked_words(meta: DataFrame, path: str, shards: int) -> DataFrame:
    """Per block and shard the distinct words, and how often they are in the block's training part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                block = _open(path, name)
                order, begins = block.by_word_shard(shards)
                for shard, (a, b) in enumerate(zip(begins, begins[1:])):
                    if a < b:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([shard], pa.int32()),
                                pa.array([name]),
                                pa.array([block.words[order[a:b]].tobytes()]),
                                pa.array([_packed(block.trained[order[a:b]])]),
                            ],
                            names=["shard", "block", "words", "counts"],
                        )

    return meta.select("block").mapInArrow(run, "shard int, block string, words binary, counts binary")


def _count_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard: counts over all blocks, the level of words, and each block's answer: counts, then
        numbers, small ones for frequent words and 0 for those that training lacks."""
        shard = table["shard"][0].as_py()
        asked = [np.frombuffer(x.as_buffer(), "<u8") for x in table["words"]]
        counts = np.concatenate([_unpacked(x.as_buffer(), "<u8") for x in table["counts"]])
        different, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.zeros(len(different), np.uint64)
        np.add.at(totals, inverse, counts)
        seen = totals > 0
        level, totals = Sequence.of(different[seen], 1 << 64), totals[seen]
        numbers = np.empty(len(totals), np.uint64)
        numbers[np.argsort(totals, kind="stable")[::-1]] = np.arange(len(totals), dtype=np.uint64)
        numbers = numbers * np.uint64(shards) + np.uint64(shard + 1)
        rows = [("", 0, np.array([totals.sum(), len(totals)], "<u8").tobytes())]
        for name, words in zip(table["block"].to_pylist(), asked):
            answer = np.zeros((2, len(words)), "<u8")
            if level.size:
                at, equal = level.successor(words)
                answer[0, equal], answer[1, equal] = totals[at[equal]], numbers[at[equal]]
            rows.append((name, 0, _packed(answer.ravel())))
        return _answers(rows, shard)

    return run


def _answers(rows: list[tuple], shard: int, book: bytes = b"") -> pa.Table:
    names, kinds, data = zip(*rows)
    n = len(rows)
    return pa.table(
        {
            "block": pa.array(names, pa.string()),
            "kind": pa.array(kinds, pa.int32()),
            "shard": pa.array([shard] * n, pa.int32()),
            "data": pa.array(data, pa.binary()),
            "book": pa.array([book] * n, pa.binary()),
        }
    )


def _by_shard(answers: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    return {
        r["shard"]: (r["data"], r["book"]) for r in answers.to_pylist() if r["kind"] == kind
    }


_ASKED = pa.schema(
    [("shard", pa.int32()), ("block", pa.string())]
    + [(n, pa.binary()) for n in ("firsts", "fans", "seconds", "totals", "children", "words", "counts")]
)


def _asked_row(shard: int, name: str, **columns: np.ndarray) -> dict:
    return {"shard": shard, "block": name, **{n: _packed(x) for n, x in columns.items()}}


def _ask_pairs(path: str, word_shards: int, shards: int, mu: float):
    def run(answers: pa.Table) -> pa.Table:
        """The distinct pairs of a block by shard: first words, how many words follow each, and these."""
        known = _Known(path, answers, word_shards, shards, mu)
        block, rows = known.block, []
        seen = np.bincount(known.inverse[block.learned()], minlength=len(known.before)).astype("<u4")
        for shard, (a, b) in enumerate(zip(known.begins, known.begins[1:])):
            if a < b:
                part = known.asked[known.dealt[a:b]]
                firsts, children = _runs(known.before[part])
                rows.append(
                    _asked_row(
                        shard,
                        answers["block"][0].as_py(),
                        firsts=known.numbers[firsts],
                        totals=known.counts[firsts],
                        children=children.astype("<u4"),
                        words=known.numbers[known.word[part]],
                        counts=seen[part],
                    )
                )
        return pa.Table.from_pylist(rows, schema=_ASKED)

    return run


def _ask_triples(path: str, word_shards: int, shards: int, mu: float):
    def run(answers: pa.Table) -> pa.Table:
        """The distinct triples of a block by shard, below their pairs, below their first words."""
        known = _Known(path, answers, word_shards, shards, mu)
        block, rows = known.block, []
        pair, word, asked, begins, place = known.triples(shards)
        learned = block.learned()[block.later()]
        seen = np.bincount(place[learned], minlength=len(pair)).astype("<u4")
        for shard, (a, b) in enumerate(zip(begins, begins[1:])):
            if a < b:
                part = asked[a:b]
                pairs, children = _runs(pair[part])
                firsts, fans = _runs(known.before[pairs])
                rows.append(
                    _asked_row(
                        shard,
                        answers["block"][0].as_py(),
                        firsts=known.numbers[firsts],
                        fans=fans.astype("<u4"),
                        seconds=known.numbers[known.word[pairs]],
                        totals=known.pair_counts[pairs],
                        children=children.astype("<u4"),
                        words=known.numbers[word[part]],
                        counts=seen[part],
                    )
                )
        return pa.Table.from_pylist(rows, schema=_ASKED)

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of successive runs and the runs' lengths."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def _below(parents: np.ndarray, children: np.ndarray):
    """The distinct nodes (parent, child) in order, and each row's place among them."""
    bits = np.uint64(max(1, int(children.max(initial=0)).bit_length()))
    key, place = np.unique((parents.astype(np.uint64) << bits) | children, return_inverse=True)
    return (key >> bits).astype(np.int64), key & ((np.uint64(1) << bits) - np.uint64(1)), place


def _build_and_find(path: str, kind: int, prior: float):
    def run(table: pa.Table) -> pa.Table:
        """One shard: its trie from all blocks' counts, written and mapped, and each block's answer."""
        shard = table["shard"][0].as_py()
        column = lambda n, of: [_unpacked(x.as_buffer(), of) for x in table[n]]
        words = column("words", "<u8")
        sizes, words = [len(x) for x in words], np.concatenate(words)
        firsts, children = np.concatenate(column("firsts", "<u8")), np.concatenate(column("children", "<u4"))
        contexts, above = np.unique(firsts, return_inverse=True)
        size, levels, asked = len(contexts), [], []
        if kind == 2:
            fans, seconds = np.concatenate(column("fans", "<u4")), np.concatenate(column("seconds", "<u8"))
            *levels, above = _below(np.repeat(above, fans), seconds)
            asked = [np.bincount(levels[0], minlength=size), levels[1]]
            size = len(levels[0])
        totals = np.zeros(size, np.uint64)
        totals[above] = np.concatenate(column("totals", "<u8"))
        parents, leaves, place = _below(np.repeat(above, children), words)
        del words, above
        sums = np.bincount(place, weights=np.concatenate(column("counts", "<u4")), minlength=len(parents))
        # A total that was read back from a quantised share may be a little below its parts' sum.
        whole = np.maximum(totals, np.bincount(parents, weights=sums, minlength=size)) if kind == 2 else totals
        seen = np.flatnonzero(sums)
        shares = sums[seen] / (whole[parents[seen]].astype(np.float64) + prior)
        trie = Trie.of(contexts, *levels, parents[seen], leaves[seen], shares)
        files = FileSet(path)
        name, stream = files.create(".trie")
        with stream:
            stream.write(trie.to_bytes())
        trie = Trie.from_buffer(files.mapped(name))
        book = trie.codebook.astype("<f4").tobytes()
        # Each different sequence is looked up once, however many blocks ask for it.
        codes = trie.find(contexts, *asked, np.bincount(parents, minlength=size), leaves)[place]
        rows = [
            (block, kind, _packed(part))
            for block, part in zip(table["block"].to_pylist(), np.split(codes, np.cumsum(sizes)[:-1]))
        ]
        return _answers(rows, shard, book)

    return run


def _score(path, word_shards, shards, trained_tokens, distinct, order, mu, nu, schema):
    def run(answers: pa.Table) -> pa.Table:
        known = _Known(path, answers, word_shards, shards, mu)
        block, counts = known.block, known.counts
        plain = (counts.astype(np.float64) + 0.5) / (trained_tokens + 0.5 * (distinct + 1))
        context = counts[known.before].astype(np.float64)
        after_one = known.shares + mu / (context + mu) * plain[known.word]
        each = after_one[known.inverse]
        if order == 3:
            pair, _, asked, begins, place = known.triples(shards)
            shares = _read(answers, 2, len(pair), asked, begins)
            at = np.flatnonzero(block.later())
            back = nu / (known.pair_counts[known.inverse[at - 1]].astype(np.float64) + nu)
            each[at] = shares[place] + back * each[at]
        starts = np.concatenate([[0], np.cumsum(block.lengths, dtype=np.int64)[:-1]])
        summed = lambda x: np.add.reduceat(x, starts)
        n = len(starts)
        return pa.table(
            [
                block.doc_ids,
                pa.array(block.held),
                pa.array(block.lengths.astype(np.int64)),
                pa.array(summed((counts > 0)[block.ids].astype(np.int64))),
                pa.array(np.full(n, trained_tokens, np.int64)),
                pa.array(summed(np.log10(plain)[block.ids])),
                pa.array(summed(np.log10(each))),
            ],
            names=schema.names,
        )

    return run


def scored(docs: DataFrame, held: Column, mu: float = MU, nu: float = NU, order: int = ORDER) -> DataFrame:
    """Learn from the rows of ``docs`` where ``held`` is false and score all: a row for each row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (single words alone) and
    score, the log10 probability of the text and its end. A word's context are the two words before it,
    or with ``order`` 2 the one. A null text is empty: the end alone. Where nothing is learned from,
    every word has probability 1. Repeated rows count as often as they occur, in learning and in the
    result. Words are compared by 64 bits of hash. Only doc_id and text are read. Tries stay in the
    shared folder, one file a shard.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    schema = docs.select("doc_id").schema.add("held_out", "boolean")
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, "long")
    schema = schema.add("base_score", "double").add("score", "double")
    path = work_folder(spark, "lm")
    meta = blocks(docs, held, path)
    n_blocks, tokens, words = meta.agg(F.count(F.lit(1)), F.sum("n_tokens"), F.sum("n_words")).first()
    if not n_blocks:
        return spark.createDataFrame([], schema)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards, shards = 1 + words // WORDS_PER_SHARD, 1 + tokens // PAIRS_PER_SHARD
    # Blocks and shards are heavy though their rows are few: they are spread by number, not by size.
    spread = meta.repartition(min(n_blocks, 4 * parallel))
    counted = written(
        _asked_words(spread, path, word_shards)
        .repartition(min(word_shards, 4 * parallel), "shard")
        .groupBy("shard")
        .applyInArrow(_count_words(word_shards), _ANSWERS),
        "lm-words",
    )
    trained_tokens = distinct = 0
    for row in counted.where("block = ''").select("data").toLocalIterator():  # one short row a shard
        n, v = np.frombuffer(row["data"], "<u8")
        trained_tokens, distinct = trained_tokens + int(n), distinct + int(v)
    answers = counted.where("block <> ''")
    by_block = min(n_blocks, 4 * parallel)
    asked = ", ".join(f"{f.name} {_sql(f.type)}" for f in _ASKED)
    rounds = [(1, _ask_pairs, mu, "lm-pairs"), (2, _ask_triples, nu, "lm-triples")]
    for kind, ask, prior, name in rounds[: order - 1]:
        found = written(
            answers.repartition(by_block, "block")
            .groupBy("block")
            .applyInArrow(ask(path, word_shards, shards, mu), asked)
            .repartition(min(shards, 4 * parallel), "shard")
            .groupBy("shard")
            .applyInArrow(_build_and_find(path, kind, prior), _ANSWERS),
            name,
        )
        answers = answers.unionByName(found)
    return (
        answers.repartition(by_block, "block")
        .groupBy("block")
        .applyInArrow(
            _score(path, word_shards, shards, trained_tokens, distinct, order, mu, nu, schema), schema
        )
    )


def _sql(kind: pa.DataType) -> str:
    return {"int32": "int", "string": "string", "binary": "binary"}[str(kind)]
