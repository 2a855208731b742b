"""Language of a text by a small convolutional network over bytes.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, so every byte sequence of a
filter's width is seen. Filters of several widths run over embedded bytes, the largest response of each goes to a
softmax, and the windows' log probabilities are averaged. The network is trained in numpy on windows of labelled texts.
For scoring, embedding and filters are multiplied out into tables over pairs of bytes; the responses are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import bounded_sample, held_out, sample_hash

WINDOW, WIDTHS, FILTERS, EMBEDDING = 192, (2, 3, 4), 12, 8
#: Labelled documents at most, windows at most of each (evenly spread over the text), and training steps.
SAMPLE_ROWS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 4_000, 6, 6, 128, 0.01, 5
#: Windows that are scored at once; it bounds memory.
SCORED = 1024
UNKNOWN = "und"


def _classes() -> np.ndarray:
    """Class of each byte: 0 blanks and padding, 1 digits, 2 other signs, 3-28 letters in either case, then bytes over 127."""
    out = np.full(256, 2, np.int64)
    out[[0, 9, 10, 11, 12, 13, 32]] = 0
    out[48:58] = 1
    out[65:91] = out[97:123] = np.arange(3, 29)
    out[128:] = np.arange(29, 157)
    return out


CLASS = _classes()
N_CLASSES = 157


def windows(data: bytes) -> np.ndarray:
    """All windows of a text as classes, the last one padded: an array of shape (windows, WINDOW)."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return CLASS[np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]]


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embedding": rng.normal(0, 0.5, (N_CLASSES, EMBEDDING)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "out_bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, x: np.ndarray):
        """Embedded windows, and for each width the places and values of the largest responses."""
        embedded = self.p["embedding"][x]
        pooled = {}
        for w in WIDTHS:
            flat = np.concatenate([embedded[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
            response = flat @ self.p[f"filter{w}"]
            at = response.argmax(axis=1)
            pooled[w] = at, np.take_along_axis(response, at[:, None], 1)[:, 0] + self.p[f"bias{w}"]
        return embedded, pooled

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for own in np.split(order, range(BATCH, len(x), BATCH)):
                g, step = self._gradient(x[own], y[own]), step + 1
                for k, grad in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        embedded, pooled = self._pooled(x)
        values = np.concatenate([pooled[w][1] for w in WIDTHS], axis=1)
        hidden = np.maximum(values, 0)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        d = np.exp(logits - logits.max(axis=1, keepdims=True))
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": hidden.T @ d, "out_bias": d.sum(axis=0), "embedding": np.zeros_like(self.p["embedding"])}
        dv = (d @ self.p["out"].T) * (values > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            at, own = pooled[w][0], dv[:, i * FILTERS : (i + 1) * FILTERS]
            places = at[:, :, None] + np.arange(w)
            seen = embedded[rows[:, :, None], places].reshape(len(x), FILTERS, -1)
            g[f"filter{w}"] = np.einsum("bfk,bf->kf", seen, own)
            g[f"bias{w}"] = own.sum(axis=0)
            back = (own[:, :, None] * self.p[f"filter{w}"].T[None]).reshape(len(x), FILTERS, w, EMBEDDING)
            np.add.at(g["embedding"], x[rows[:, :, None], places].ravel(), back.reshape(-1, EMBEDDING))
        return g

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, responses of byte pairs (and a last single byte) as tables."""
        out = {}
        for w in WIDTHS:
            parts = np.einsum("ce,wef->wcf", self.p["embedding"], self.p[f"filter{w}"].reshape(w, EMBEDDING, FILTERS))
            tables = [(parts[i][:, None] + parts[i + 1][None]).reshape(-1, FILTERS) for i in range(0, w - 1, 2)]
            out[w] = tables + ([parts[w - 1]] if w % 2 else [])
        return out

    def log_probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        pairs = x[:, :-1] * N_CLASSES + x[:, 1:]
        values = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            response = None
            for i, t in enumerate(tables[w]):
                of = t[(pairs if len(t) > N_CLASSES else x)[:, 2 * i : 2 * i + n]]
                response = of if response is None else np.add(response, of, out=response)
            values.append(response.max(axis=1) + self.p[f"bias{w}"])
        logits = np.maximum(np.concatenate(values, axis=1), 0) @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame) -> Network | None:
    """A network trained on at most SAMPLE_ROWS documents with a language that are not held out; None without any.

    Documents are picked by a hash of the id, windows evenly over each whole text, and languages with few windows repeat
    theirs up to a quarter of the most frequent one's. Training runs in one task, whose input the bounds limit.
    """
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    bound = bounded_sample(docs.filter(usable).select("doc_id"), F.col("doc_id"), SAMPLE_ROWS)
    if bound is None:
        return None
    sample = docs.filter(usable & (sample_hash(F.col("doc_id")) <= bound)).select("doc_id", "text", "lang").dropDuplicates()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, lang in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "lang"))):
                if has_letter(t):
                    own = windows(t.encode("utf-8", "surrogatepass"))
                    take = np.unique(np.linspace(0, len(own) - 1, SAMPLE_WINDOWS).astype(int))
                    out.append((i, lang, own[take].astype(np.uint8).tobytes()))
            ids, langs, data = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["id", "lang", "windows"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        rows = sorted(r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("id", "lang", "windows"))))
        if not rows:
            return
        languages = sorted({r[1] for r in rows})
        xs = {lang: np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in rows if r[1] == lang]) for lang in languages}
        most = max(map(len, xs.values()))
        xs = {lang: np.concatenate([x] * max(1, -(-most // 4 // len(x)))) for lang, x in xs.items()}
        network = Network(languages)
        network.train(np.concatenate(list(xs.values())).astype(np.int64), np.concatenate([np.full(len(x), i) for i, x in enumerate(xs.values())]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((languages, network.p))], pa.binary())], ["network"])

    cuts = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(cut, "id long, lang string, windows binary")
    found = cuts.repartition(1).mapInArrow(trained, "network binary").first()
    if found is None:
        return None
    import pickle

    languages, parameters = pickle.loads(found["network"])
    network = Network(languages)
    network.p = parameters
    return network


def identify(docs: DataFrame, network: Network | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability to every row; ``und`` and 0 for a null text or one without letters.

    Without a network every text is ``und``. Repeated rows are judged alike; an empty table stays empty.
    """
    if network is None:
        return docs.withColumn(lang, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    # Some ten thousand numbers. Plain ones: a broadcast object of an own class could be read by tasks with the package only.
    shared = docs.sparkSession.sparkContext.broadcast((network.languages, network.p))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, parameters = shared.value
        net = Network(languages)
        net.p = parameters
        tables = net.tables()
        for batch in batches:
            total, n = np.zeros((len(batch), len(net.languages))), np.zeros(len(batch))
            held, owners, waiting = [], [], 0

            def score_held():
                x, who = np.concatenate(held), np.concatenate(owners)
                for i in range(0, len(x), SCORED):
                    part = net.log_probabilities(x[i : i + SCORED], tables)
                    np.add.at(total, who[i : i + SCORED], part)
                held.clear(), owners.clear()

            for i, t in enumerate(batch):
                t = t.as_py()
                if not has_letter(t):
                    continue
                own = windows(t.encode("utf-8", "surrogatepass"))
                n[i] = len(own)
                held.append(own)
                owners.append(np.full(len(own), i))
                waiting += len(own)
                if waiting >= 4 * SCORED:
                    score_held()
                    waiting = 0
            if held:
                score_held()
            mean = total / np.maximum(n, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, n)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(n > 0, p.max(axis=1), 0.0))], ["lang", "score"])

    judged = F.arrow_udf(run, "lang string, score double")(F.col(text))
    kept = [c for c in docs.columns if c not in (lang, score)]
    return docs.select(*kept, judged.alias("_judged")).select(*kept, F.col("_judged.lang").alias(lang), F.col("_judged.score").alias(score))
