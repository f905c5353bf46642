"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm.common import own

UNKNOWN = "und"
HIDDEN = 12
WINDOW = 24  # bytes of a sequence: a word, or a window of a longer one
SAMPLE_ROWS = 150  # labelled rows per language whose whole texts the network is fitted on, at most
STEPS = 450
BATCH = 256
CACHED = 400_000  # words whose pooled probabilities a worker keeps
GROUP = 1 << 20  # bytes of text handled at a time

_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """A GRU each way over the bytes of a sequence, and a softmax over languages at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        normal = lambda *shape: (draw.normal(size=shape) * 0.3).astype(np.float32)
        self.weights = {}
        for way in ("f", "b"):
            self.weights[f"E{way}"] = normal(256, 3 * hidden)  # what a byte adds to z, r, candidate
            self.weights[f"U{way}"] = normal(hidden, 3 * hidden)
        self.weights["W"] = normal(2 * hidden, len(languages))
        self.weights["c"] = np.zeros(len(languages), np.float32)

    def _pass(self, way: str, steps: np.ndarray, keep: bool):
        """States after each step; steps: bytes, time by sequence. keep: what BPTT needs as well."""
        n, E, U = self.hidden, self.weights[f"E{way}"], self.weights[f"U{way}"]
        state = np.zeros((steps.shape[1], n), np.float32)
        states, tape = np.empty((*steps.shape, n), np.float32), []
        for t, taken in enumerate(steps):
            x, h = E[taken], state @ U
            gates = _sigmoid(x[:, : 2 * n] + h[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * h[:, 2 * n :])
            if keep:
                tape.append((state, z, r, h[:, 2 * n :], new))
            state = new + z * (state - new)
            states[t] = state
        return states, tape

    @staticmethod
    def _reversed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Index that turns each sequence round within its own size; it is its own inverse."""
        time = np.arange(steps.shape[0])[:, None]
        return np.where(time < sizes, sizes - 1 - time, time)

    def positions(self, steps: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Probabilities of the languages at every position: time by sequence by language."""
        turn, column = self._reversed(steps, sizes), np.arange(steps.shape[1])
        ahead, tape_f = self._pass("f", steps, keep)
        back, tape_b = self._pass("b", steps[turn, column], keep)
        both = np.concatenate([ahead, back[turn, column]], axis=2)
        logits = both @ self.weights["W"] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, both, turn, tape_f, tape_b

    def gradients(self, steps: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict:
        """Of the mean cross-entropy over positions, by backpropagation through time."""
        n, (time, count) = self.hidden, steps.shape
        p, both, turn, tape_f, tape_b = self.positions(steps, sizes, keep=True)
        real = (np.arange(time)[:, None] < sizes).astype(np.float32)
        delta = p
        delta[:, np.arange(count), labels] -= 1
        delta *= (real / real.sum())[:, :, None]
        found = {"W": both.reshape(-1, 2 * n).T @ delta.reshape(-1, delta.shape[2]), "c": delta.sum((0, 1))}
        into = delta @ self.weights["W"].T
        column = np.arange(count)
        for way, tape, taken, out in (
            ("f", tape_f, steps, into[:, :, :n]),
            ("b", tape_b, steps[turn, column], into[:, :, n:][turn, column]),
        ):
            U = self.weights[f"U{way}"]
            dE, dU = np.zeros_like(self.weights[f"E{way}"]), np.zeros_like(U)
            carried = np.zeros((count, n), np.float32)
            for t in range(time - 1, -1, -1):
                state, z, r, h, new = tape[t]
                d = carried + out[t]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (state - new) * z * (1 - z)
                d_r = d_new * h * r * (1 - r)
                into_h = np.concatenate([d_z, d_r, d_new * r], axis=1)
                dU += state.T @ into_h
                np.add.at(dE, taken[t], np.concatenate([d_z, d_r, d_new], axis=1))
                carried = d * z + into_h @ U.T
            found[f"E{way}"], found[f"U{way}"] = dE, dU
        return found

    def fit(self, words: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> None:
        """Adam on random words, as many of each language. words: the sequences of each language."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(w) for k, w in self.weights.items()}
        known = [k for k, w in enumerate(words) if w]
        for step in range(1, steps + 1 if known else 0):
            labels = draw.choice(known, batch)
            taken = [words[k][draw.integers(len(words[k]))] for k in labels]
            rate = 0.02 * (1 - (step - 1) / steps) + 0.001
            for k, g in self.gradients(*laid_out(taken), labels).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                towards = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] = (self.weights[k] - rate * towards).astype(np.float32)

    def pooled(self, words: list[bytes], at_once: int = 4096) -> np.ndarray:
        """For each word the sums over its positions of the probabilities, and its positions."""
        found = np.zeros((len(words), len(self.languages) + 1), np.float32)
        windows, of = [], []
        for i, word in enumerate(words):
            for at in range(0, len(word), WINDOW):
                windows.append(word[at : at + WINDOW])
                of.append(i)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        for at in range(0, len(order), at_once):
            part = order[at : at + at_once]
            steps, sizes = laid_out([windows[i] for i in part])
            p = self.positions(steps, sizes)[0]
            p *= (np.arange(len(steps))[:, None] < sizes)[:, :, None]
            sums = np.concatenate([p.sum(axis=0), sizes[:, None]], axis=1)
            np.add.at(found, [of[i] for i in part], sums.astype(np.float32))
        return found


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, time by sequence, filled up with zeros; and the sequences' sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    longest = int(sizes.max(initial=1))
    flat = np.frombuffer(b"".join([w.ljust(longest, b"\0") for w in words]), np.uint8)
    return flat.reshape(len(words), longest).T, sizes


def sequences(text: str) -> list[bytes]:
    """A text's words, split by ASCII white space; no byte but that white space is left out."""
    return text.encode("utf-8", "surrogatepass").split()


class Labeller:
    """Documents' pooled probabilities; a word seen before is looked up instead of run again."""

    def __init__(self, network: Network) -> None:
        self.network, self.rows = network, {}
        self.table = np.zeros((0, len(network.languages) + 1), np.float32)

    def _table_of(self, words: list[bytes]) -> np.ndarray:
        missing = list({w for w in words if w not in self.rows})
        if missing:
            if len(self.rows) + len(missing) > CACHED and self.rows:
                self.rows, self.table = {}, self.table[:0]
                missing = list(set(words))
            self.table = np.concatenate([self.table, self.network.pooled(missing)])
            self.rows.update(zip(missing, range(len(self.rows), len(self.rows) + len(missing))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.network.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [sequences(t) if t and _LETTER.search(t) else [] for t in texts]
        rows = self._table_of([w for some in words for w in some])
        found, at = [], 0
        for some in words:
            if not some:
                found.append((UNKNOWN, 0.0))
            else:
                sums = self.table[rows[at : at + len(some)]].sum(axis=0, dtype=np.float64)
                best = int(sums[:-1].argmax())
                found.append((self.network.languages[best], min(1.0, float(sums[best] / sums[-1]))))
            at += len(some)
        return found


def held_out(remainder: int = 2, modulus: int = 4) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id counts as an empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus == remainder


def fitted(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on a bounded sample of the rows of ``docs`` where ``learn`` holds.

    Of each language the ``rows`` rows with the smallest hash of id and text are taken, with their whole
    texts: so many texts a language come to the driver. Only rows whose hash is below a bound by the
    language's count are ranked, about twice as many as are taken, however large the table is.
    """
    mark, rank, draw = own("mark"), own("rank"), own("draw")
    keys = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.xxhash64("doc_id", "text").alias(mark), "text"
    )
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return Network([])
    parts = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * rows + 100) / n))]
    bound = F.element_at(F.create_map(*parts), F.col("lang"))
    # The hash as a fraction, in the order of the hash.
    drawn = keys.select("lang", mark).withColumn(draw, F.col(mark) / F.lit(2.0**64) + F.lit(0.5))
    first = Window.partitionBy("lang").orderBy(mark)
    chosen = drawn.where(F.col(draw) <= bound).withColumn(rank, F.row_number().over(first))
    chosen = chosen.where(F.col(rank) <= rows)
    sample = (
        keys.join(F.broadcast(chosen.select("lang", mark).distinct()), ["lang", mark], "left_semi")
        .dropDuplicates(["lang", mark])
    )
    found = sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").collect())
    languages = sorted({lang for lang, _ in found})
    words: list[list[bytes]] = [[] for _ in languages]
    for lang, text in found:
        own_words = words[languages.index(lang)]
        for word in sequences(text):
            own_words.extend(word[at : at + WINDOW] for at in range(0, len(word), WINDOW))
    network = Network(languages)
    network.fit(words)
    return network


def identified(docs: DataFrame, network: Network) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``, from its whole text alone.

    Every byte but white space is labelled; a document's probability is the mean over them, and the
    score that of the language predicted. A text that is null or has no letter is ``und`` with score 0;
    so is every text if nothing was learned from. Ties go to the language first in order. Rows pass
    one by one, in their place. Columns named ``lang_pred`` or ``score`` are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[f"`{c}`" for c in rest])
    schema = T.StructType(list(source.schema.fields)).add("lang_pred", "string").add("score", "double")
    text_at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(network)
        for batch in batches:
            found, group, size = [], [], 0
            for text in batch.column(text_at):
                group.append(text.as_py())
                size += len(group[-1] or "")
                if size >= GROUP:
                    found += labeller.label(group)
                    group, size = [], 0
            found += labeller.label(group)
            languages, scores = [x[0] for x in found], [x[1] for x in found]
            arrays = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)
