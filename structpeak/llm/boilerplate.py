"""Quality rules: lines labelled content or boilerplate by Viterbi decoding of a linear-chain field.

A line with a word is one position, a document's lines are one sequence. Indicator features tell
a line's length, its shares of signs, capitals, digits and repeated words, how much of it lies in
word windows that the document repeats, whether it equals an earlier line, how long its words
are, how it ends and where it stands. Weights and transitions are learned from labelled
documents. A document is kept when lines labelled content hold at least half of its word
characters and it doesn't fail the base rules (too few words, too many repeated word windows).

Null texts have no words and fail the base rules, as empty ones do. Without labelled documents of
both kinds every line counts as content. Rows may repeat; each is judged alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.crf import Chain, fit, scores, viterbi
from structpeak.llm.textbuf import CONTINUES, LOWER, blocks, column_bytes, mix, runs_of, span_keys, windows, words

#: Fixed values of the base rules.
SYMBOLS, WINDOW_WORDS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Share of a document's word characters that must lie in content lines.
CONTENT_SHARE = 0.5
#: Labelled documents of each kind that the model is fitted on, the ones of smallest hash.
FIT_DOCUMENTS = 1000
#: Upper edges of the buckets of each measure of a line.
EDGES = {
    "characters": [20, 60, 150, 400, 1000],
    "signs": [0.02, 0.05, 0.1, 0.2, 0.35],
    "symbols": [0.0, 0.02, 0.05, 0.1],
    "capitals": [0.05, 0.15, 0.5, 0.9],
    "digits": [0.0, 0.05, 0.2],
    "same": [0.0, 0.05, 0.15, 0.4],
    "repeated": [0.0, 0.1, 0.3, 0.6],
    "word": [3.0, 5.0, 8.0, 14.0],
    "stop": [0.5],
    "earlier": [0.5],
    "first": [0.5],
    "last": [0.5],
}
WIDTH = max(map(len, EDGES.values())) + 1
FEATURES = len(EDGES) * WIDTH
CONTENT, BOILERPLATE = 0, 1
#: Bytes of text judged at once: what is counted of a byte takes a hundred times its place.
JUDGED_BYTES = 500_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = pa.struct([*((c, pa.int64()) for c in COUNTS), ("content_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_symbol, _digit, _capital = _table(SYMBOLS), _table(b"0123456789"), _table(bytes(range(65, 91)))
_letter = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def analyse(data: np.ndarray, borders: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each document; then each line's document, feature ids (one of each measure) and word characters."""
    n = len(borders) - 1
    start, end, document = words(data, borders)
    total = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    points, symbols = total(~CONTINUES[data]), total(_symbol[data])
    signs = total(~(_letter[data] | _digit[data] | CONTINUES[data]))
    word = span_keys(data, start, end)
    size = points[end] - points[start]
    out = {
        "n_words": np.bincount(document, minlength=n),
        "word_chars": np.bincount(document, size, n).astype(np.int64),
        "n_symbols": symbols[borders[1:]] - symbols[borders[:-1]],
    }
    # words in windows that stand twice or more in their document
    salt = mix(document.astype(np.uint64) + np.uint64(1))
    mark = np.zeros(len(word) + 1, np.int64)
    hashed, at = windows(word, document, WINDOW_WORDS)
    if len(at):
        _, which, times = np.unique(hashed ^ salt[at], return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        np.add.at(mark, twice, 1)
        np.add.at(mark, twice + WINDOW_WORDS, -1)
    repeated = np.cumsum(mark)[:-1] > 0
    out["n_repeat_words"] = np.bincount(document[repeated], minlength=n)
    # lines with a word
    breaks = np.flatnonzero(data == 0x0A)
    line_of_word = np.searchsorted(breaks, start) + document if len(start) else np.zeros(0, np.int64)  # a document border also ends a line
    fresh = np.ones(len(start), bool)
    fresh[1:] = line_of_word[1:] != line_of_word[:-1]
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(start))
    owner = document[head]
    position = np.searchsorted(breaks, start[head])
    lo = np.maximum(borders[owner], np.concatenate(([0], breaks + 1))[position]) if len(head) else head
    hi = np.minimum(borders[owner + 1], np.append(breaks, len(data))[position]) if len(head) else head
    line = span_keys(data, lo, hi) ^ mix(owner.astype(np.uint64) + np.uint64(1))
    _, first_seen, same = np.unique(line, return_index=True, return_inverse=True)
    earlier = np.arange(len(head)) != first_seen[same] if len(head) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(owner[earlier], minlength=n)
    count = tail - head
    by_line = np.repeat(np.arange(len(head)), count)
    chars = np.bincount(by_line, size, len(head)).astype(np.int64)
    low_word = span_keys(LOWER[data], start, end)
    kinds = np.bincount(by_line[np.unique(low_word ^ mix(by_line.astype(np.uint64) + np.uint64(9)), return_index=True)[1]], minlength=len(head)) if len(head) else count
    share = lambda sums: (sums[end[tail - 1]] - sums[start[head]]) / np.maximum(chars, 1) if len(head) else np.zeros(0)
    gaps = points[end[tail - 1]] - points[start[head]] - chars if len(head) else 0  # white space between the words
    ends = runs_of(owner, n)
    is_first, is_last = np.zeros(len(head)), np.zeros(len(head))
    some = np.flatnonzero(np.diff(ends))
    is_first[ends[:-1][some]], is_last[ends[1:][some] - 1] = 1, 1
    measure = {
        "characters": chars, "signs": np.maximum(share(signs) - gaps / np.maximum(chars, 1), 0), "symbols": share(symbols), "capitals": share(total(_capital[data])), "digits": share(total(_digit[data])),
        "same": 1 - kinds / np.maximum(count, 1), "repeated": np.bincount(by_line, repeated, len(head)) / np.maximum(count, 1), "word": chars / np.maximum(count, 1),
        "stop": _table(b".!?")[data[end[tail - 1] - 1]] if len(head) else np.zeros(0), "earlier": earlier, "first": is_first, "last": is_last,
    }
    ids = np.stack([k * WIDTH + np.searchsorted(EDGES[name], np.asarray(measure[name], float)) for k, name in enumerate(EDGES)], axis=1) if len(head) else np.zeros((0, len(EDGES)), np.int64)
    return out, owner, ids, chars


def train(labelled: DataFrame, text: str = "text", label: str = "quality", fit_documents: int = FIT_DOCUMENTS) -> Chain | None:
    """Learns from rows whose ``label`` is 1 (content) or 0 (boilerplate), at most ``fit_documents`` of each; None if one kind is missing."""
    some = labelled.where(F.col(label).isin(0, 1) & (F.length(text) > 0)).select((1 - F.col(label)).cast("int").alias("gold"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    cells = some.select("gold", F.struct("at", "text").alias("row")).groupBy("gold", F.pmod(F.col("row.at"), F.lit(fit_documents)).alias("cell")).agg(F.min("row").alias("row"))
    rows = cells.orderBy("gold", "cell").collect()  # at most 2 * fit_documents rows
    gold_of = np.array([r["gold"] for r in rows], np.int64)
    if len(set(gold_of.tolist())) < 2:
        return None
    texts = [r["row"]["text"].encode() for r in rows]
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    owner, ids = [], []
    for lo, _, part, local in blocks(np.frombuffer(b"".join(texts), np.uint8), borders):
        _, own, index, _ = analyse(part, local)
        owner.append(own + lo)
        ids.append(index)
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    return fit(ids.ravel(), np.arange(len(ids) + 1) * len(EDGES), np.arange(len(ids)), gold_of[owner], runs_of(owner, len(rows)), FEATURES, 2, rounds=120)


def verdicts(texts: pa.Array, chain: Chain | None, content_share: float = CONTENT_SHARE) -> pa.StructArray:
    """Base counts, ``content_share``, ``base_failed`` and ``kept`` of every text."""
    data, borders, _ = column_bytes(texts)
    found = [pa.array([], VERDICT)]
    for lo, hi, part, local in blocks(data, borders, JUDGED_BYTES):
        base, owner, ids, chars = analyse(part, local)
        good = np.ones(len(owner), bool)
        if chain is not None and len(owner):
            emit = scores(chain.weight, ids.ravel(), np.arange(len(ids) + 1) * len(EDGES))
            good = viterbi(emit, runs_of(owner, hi - lo), chain) == CONTENT
        share = np.bincount(owner, chars * good, hi - lo) / np.maximum(np.bincount(owner, chars, hi - lo), 1)
        failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
        own = [*(base[c].astype(np.int64) for c in COUNTS), share, failed, ~failed & (share >= content_share)]
        found.append(pa.StructArray.from_arrays([pa.array(x) for x in own], fields=list(VERDICT)))
    return pa.concat_arrays(found)


def judge(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text", content_share: float = CONTENT_SHARE, carry: list[str] | None = None) -> DataFrame:
    """Base counts, ``content_share``, ``base_failed`` and ``kept`` for every row, behind the columns named in ``carry``.

    Only texts go to the Python workers, once, and only verdicts come back; all other columns stay where they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield verdicts(texts, chain, content_share)

    names = [key, *(carry or [])]
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", content_share double, base_failed boolean, kept boolean"
    judged = docs.select(*(docs[c].alias(f"own_{k}") for k, c in enumerate(names)), F.arrow_udf(run, schema)(docs[text]).alias("verdict"))
    return judged.select(*(F.col(f"own_{k}").alias(c) for k, c in enumerate(names)), *(f"verdict.{c}" for c in VERDICT.names))
