"""Language of documents by a linear-chain conditional random field over their words.

Words (runs of bytes that are no white space) carry indicator features: the word, its affixes of
one to four bytes, its byte bigrams and trigrams, and for each language whether its lexicon has
the word. A line is a sequence. Labels come from documents whose language is known; half of the
training lines are spliced from lines of two languages, so that the model learns transitions inside
code-switched text. Forward-backward gives every word its language probabilities; a document
takes the language with the largest sum over its words with a letter.

Texts that are null or have no letter are ``und`` with score 0, and so is everything when no row
has a language to learn from. Equal texts get equal answers; ties go to the first language in
alphabetical order. Only ``key`` and the text are read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.byte_pairs import LETTER, _classes
from structpeak.llm.crf import Chain, fit, forward_backward, scores
from structpeak.llm.textbuf import CONTINUES, LOWER, blocks, column_bytes, mix, prefix_hash, span_hash, spans, words

FEATURE_BITS = 16
#: Labelled documents of each language that the model is fitted on, the ones of smallest hash.
FIT_DOCUMENTS = 150
#: Lexicon words of each language, and the share of a word's uses that must be in it.
LEXICON_WORDS, LEXICON_SHARE = 400, 0.9


@dataclass
class Model:
    languages: list[str]
    chain: Chain
    lexicon: dict[int, int]  # word hash -> language


def _word_table(data: np.ndarray, borders: np.ndarray):
    """Starts, ends, documents and lower-case hashes of words, the borders of lines in words, and which words have a letter."""
    low = LOWER[data]
    start, end, document = words(data, borders)
    prefix = prefix_hash(low)
    key = mix(span_hash(prefix, start, end))
    line_end = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(line_end, start)
    fresh = np.ones(len(start) + 1, bool)
    if len(start):
        fresh[1:-1] = (line[1:] != line[:-1]) | (document[1:] != document[:-1])
    cut = np.flatnonzero(fresh)
    lead = ~CONTINUES[data]
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letters = np.zeros(len(data) + 1, np.int64)
    here = np.zeros(len(data), np.int64)
    here[lead] = _classes()[point] == LETTER
    np.cumsum(here, out=letters[1:])
    return low, prefix, start, end, document, key, cut, letters[end] > letters[start]


def _features(low: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, model_lexicon: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of units (distinct words) in CSR form."""
    n, length = len(start), end - start
    parts, owner = [key], [np.arange(n)]
    for size in range(1, 5):
        ok = np.flatnonzero(length >= size)
        for kind, lo in ((1, start[ok]), (2, end[ok] - size)):
            parts.append(mix(span_hash(prefix, lo, lo + size) + np.uint64(kind * 1_000_003 + size)))
            owner.append(ok)
    for size in (2, 3):
        count = np.maximum(length - size + 1, 0)
        lo = np.repeat(start, count) + spans(count)
        parts.append(mix(span_hash(prefix, lo, lo + size) + np.uint64(7_000_003 + size)))
        owner.append(np.repeat(np.arange(n), count))
    index = [p & np.uint64((1 << FEATURE_BITS) - 1) for p in parts]
    known = np.fromiter((model_lexicon.get(k, -1) for k in key.tolist()), np.int64, n)
    hit = np.flatnonzero(known >= 0)
    index.append(((1 << FEATURE_BITS) + known[hit]).astype(np.uint64))
    owner.append(hit)
    owner, index = np.concatenate(owner), np.concatenate(index).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return index[order], np.searchsorted(owner[order], np.arange(n + 1))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fits on at most ``fit_documents`` documents of each language; the rest of ``labelled`` only competes to be chosen."""
    some = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    names = sorted(r["lang"] for r in some.select("lang").distinct().collect())
    cells = some.select("lang", F.struct("at", "text").alias("row")).groupBy("lang", F.pmod(F.col("row.at"), F.lit(fit_documents)).alias("cell")).agg(F.min("row").alias("row"))
    rows = cells.orderBy("lang", "cell").collect()  # at most fit_documents rows a language
    label = {name: k for k, name in enumerate(names)}
    texts, gold_of = [r["row"]["text"].encode() for r in rows], np.array([label[r["lang"]] for r in rows], np.int64)
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    low, prefix, start, end, document, key, cut, letters = _word_table(data, borders)
    gold = gold_of[document] if len(document) else np.zeros(0, np.int64)
    for_lexicon = document % 2 == 0
    lexicon: dict[int, int] = {}
    for k in range(len(names)):
        word, uses = np.unique(key[for_lexicon & (gold == k) & letters], return_counts=True)
        every, all_uses = np.unique(key[for_lexicon], return_counts=True)
        share = uses / all_uses[np.searchsorted(every, word)] if len(word) else uses
        good = np.flatnonzero((share >= LEXICON_SHARE) & (uses >= 3))
        best = good[np.lexsort((word[good], -uses[good]))][:LEXICON_WORDS]
        lexicon |= dict.fromkeys(word[best].tolist(), k)
    # lines of documents that gave no lexicon words; every second one goes on with another line
    line = np.flatnonzero(~for_lexicon[cut[:-1]]) if len(cut) > 1 else np.zeros(0, np.int64)
    other = np.random.default_rng(7).permutation(line)
    pieces = []
    for i, (a, b) in enumerate(zip(line.tolist(), other.tolist(), strict=True)):
        own = np.arange(cut[a], cut[a + 1])
        pieces.append(own if i % 2 else np.concatenate((own[: (len(own) + 1) // 2], np.arange((cut[b] + cut[b + 1]) // 2, cut[b + 1]))))
    position = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    unit, first, which = np.unique(key[position], return_index=True, return_inverse=True)
    first = position[first] if len(position) else first
    index, ptr = _features(low, prefix, start[first], end[first], unit, lexicon)
    size = np.array([len(p) for p in pieces], np.int64)
    chain = fit(index, ptr, which, gold[position], np.concatenate(([0], np.cumsum(size))), (1 << FEATURE_BITS) + len(names), max(len(names), 1))
    return Model(names, chain, lexicon)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for every row."""
    names = np.array([*model.languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                n, k = hi - lo, max(len(model.languages), 1)
                total, count = np.zeros((n, k)), np.zeros(n)
                if len(part) and model.languages:
                    low, prefix, start, end, document, word, cut, letters = _word_table(part, local)
                    unit, first, which = np.unique(word, return_index=True, return_inverse=True)
                    index, ptr = _features(low, prefix, start[first], end[first], unit, model.lexicon)
                    marginal, *_ = forward_backward(scores(model.chain.weight, index, ptr)[which], cut, model.chain)
                    votes = document[letters]
                    count = np.bincount(votes, minlength=n)
                    total = np.stack([np.bincount(votes, marginal[letters, j], n) for j in range(k)], axis=1)
                best = np.where(count > 0, total.argmax(axis=1), len(names) - 1)
                score = np.where(count > 0, total.max(axis=1) / np.maximum(count, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
