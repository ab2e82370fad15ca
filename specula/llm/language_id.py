"""Language identification: script ranges, per-word scores and Viterbi over a text's words.

A word's letters tell its script, and only languages that the training texts show in this script are candidates. The word
is scored for each by the log-likelihood of its byte n-grams; a Viterbi path over the text's words with a penalty for each
switch labels spans of one language. The text's language is the one that holds most letters, its score the share it holds.

Model: counts of hashed n-grams per language, a table of fixed size, and letters per script and language. It is fitted on
about ROWS_PER_LANGUAGE labelled texts of each language, chosen by a hash of the text.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from specula.llm.common import text_chunks
from specula.llm.tokens import U, fmix, splitmix

#: Bound of the training sample: an expected number of distinct texts of each language.
ROWS_PER_LANGUAGE = 1500
BITS, LENGTHS, SMOOTH = 16, (1, 2, 3, 4, 5), 0.5
#: A word says at most so much against a language; what a switch costs; a language's share of a script's letters.
WORD_LIMIT, SWITCH, SHARE = 12.0, 18.0, 0.01
MAX_LANGUAGES = 256
CACHED = 400_000
UNKNOWN = "und"
#: The share of a text's letters that its language must hold where texts of one language are wanted.
LEAST_SHARE = 0.25


def _ranges(kinds: str) -> str:
    """The code points of these major categories of Unicode as ranges of a character class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    starts = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    ends = [c for c, after in zip(found, [*found[1:], -2]) if after != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


_WORD = re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*")
#: Most texts have only characters that these ranges leave out: among them are no marks, and of word characters what is no letter is listed.
_OTHER = re.compile("[^\x00-\u02ff\u2000-\u206f\u20a0-\u20cf\u2190-\u23ff]")
_PLAIN = re.compile("[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")
#: First code points of scripts' main ranges in Unicode; the last range of a script ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"),
    (0xFB00, "other"), (0x20000, "Han"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int8)


def letter_words(text: str) -> list[str]:
    """The words of a text: a letter and the letters and marks (vowel signs, accents) that follow."""
    return (_WORD if _OTHER.search(text) else _PLAIN).findall(text)


def script(word: str) -> int:
    """Number of the script of a word's first letter."""
    return int(_OF[np.searchsorted(_STARTS, ord(word[0]), "right") - 1])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every byte n-gram of the lower-cased words, each between two marks."""
    raw = [b"\x01" + w.lower().encode() + b"\x01" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    odds = splitmix(201, max(LENGTHS)) | U(1)
    buckets, owners = [], []
    total = np.zeros(len(data), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        total = total[:m] + (data[n - 1 :] + U(1)) * odds[n - 1]
        if n in LENGTHS:
            inside = owner[:m] == owner[n - 1 :]
            buckets.append((fmix(total[inside] + U(n)) >> U(64 - BITS)).astype(np.int64))
            owners.append(owner[:m][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, texts: np.ndarray):
        """counts: languages x buckets; scripts: languages x scripts, letters; texts: training texts of each language."""
        self.languages = languages
        likely = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
        self.table = np.ascontiguousarray(np.log(likely).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.candidates = (share >= SHARE).T
        self.candidates[~self.candidates.any(1)] = True  # a script unseen in training leaves all languages
        self.prior = np.log((texts + 1) / (texts + 1).sum()).astype(np.float32)
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)

    def _learn(self, words: list[str]) -> None:
        buckets, owner = _grams(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = np.argsort(owner, kind="stable")
        firsts = np.searchsorted(owner[order], np.arange(len(words)))
        if len(order):
            out = np.add.reduceat(self.table[buckets[order]], firsts, axis=0)
        out[~self.candidates[[script(w) for w in words]]] = -np.inf
        out = np.maximum(out - out.max(1, keepdims=True), -WORD_LIMIT)
        base = len(self.seen)
        self.seen.update((w, base + k) for k, w in enumerate(words))
        self.scores = np.concatenate([self.scores, out.astype(np.float32)])

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(language number of every word, number of each text's first word and behind the last)."""
        if len(self.seen) > CACHED:
            self.seen, self.scores = {}, self.scores[:0]
        flat = [w for t in texts for w in t]
        firsts = np.cumsum([0, *map(len, texts)])
        if new := list(dict.fromkeys(w for w in flat if w not in self.seen)):
            self._learn(new)
        if not flat:
            return np.zeros(0, np.int64), firsts
        scores = self.scores[np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))]
        full = np.flatnonzero(np.diff(firsts))
        starts, sizes = firsts[full], np.diff(firsts)[full]
        row = np.repeat(np.arange(len(full)), sizes)
        total = np.add.reduceat(scores, starts, axis=0) + self.prior
        best = total.argmax(1)
        out = best[row]
        if len(self.languages) > 1:
            # Leaving the best language gains at most the largest sum of a run of these, and each time costs a switch.
            held = scores[np.arange(len(flat)), out]
            led = scores.copy()
            led[np.arange(len(flat)), out] = -np.inf
            gain = led.max(1).astype(np.float64) - held
            gain[starts] += self.prior.max() - self.prior[best]
            run = np.cumsum(gain)
            before = run - gain
            step = float(np.abs(run).max()) * 2 + 1
            low = np.minimum.accumulate(before - row * step) + row * step
            most = np.maximum.reduceat(run - low, starts)
            mixed = np.flatnonzero(most > SWITCH)
            if len(mixed):
                self._viterbi(scores, starts[mixed], sizes[mixed], out)
        return out, firsts

    def _viterbi(self, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """Best paths of several texts at once, one word of each a step; a text leaves when it ends."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        at = self.prior + scores[starts]
        back = np.empty(scores.shape, np.uint8)
        own = np.arange(scores.shape[1], dtype=np.uint8)
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t))
            now, word = at[:n], starts[:n] + t
            lead = now.argmax(1)
            jump = now[np.arange(n), lead][:, None] - SWITCH
            back[word] = np.where(now >= jump, own, lead[:, None].astype(np.uint8))
            at[:n] = np.maximum(now, jump) + scores[word]
        state = at.argmax(1)
        for t in range(int(sizes[0]) - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -t))
            word = starts[:n] + t
            out[word] = state[:n]
            if t:
                state[:n] = back[word, state[:n]]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of about ROWS_PER_LANGUAGE distinct texts of each language; rows without text or language are left out.

    The texts of the sample are counted by the tasks; what comes to the driver is a table of fixed size per language.
    Without any labelled row the model knows no language, and every text is UNKNOWN.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    # Copies of a text count as rows of the language, but only one of them is learnt from.
    texts = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("k")).groupBy("lang").agg(F.sum("k"), F.count(F.lit(1)))
    found = texts.limit(MAX_LANGUAGES + 1).toArrow().to_pandas()
    counts, distinct = ({k: n for k, n in zip(found.iloc[:, 0], found.iloc[:, c])} for c in (1, 2))
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, len(_NAMES))), np.zeros(0))
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(min(1.0, ROWS_PER_LANGUAGE / distinct[k]))))])
    # The same texts whatever the partitions are: by the text's own hash.
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < limit[F.col("lang")] * (1 << 20)).distinct()

    def run(batches):
        number = {k: i for i, k in enumerate(languages)}
        grams = np.zeros((len(languages), 1 << BITS), np.int64)
        letters = np.zeros((len(languages), len(_NAMES)), np.int64)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begin, end, *_ in text_chunks(batch, "text"):
                for lang, text in zip(langs[begin:end], batch.column("text").slice(begin, end - begin).to_pylist()):
                    k = number[lang]
                    if words := letter_words(text):
                        grams[k] += np.bincount(_grams(words)[0], minlength=1 << BITS)
                        for w in words:
                            letters[k, script(w)] += len(w)
        whole = np.concatenate([grams, letters], axis=1)
        k, b = np.nonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(whole[k, b])], ["k", "b", "n"])

    found = chosen.mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros((len(languages), (1 << BITS) + len(_NAMES)), np.int64)
    whole[found.column("k").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, whole[:, : 1 << BITS], whole[:, 1 << BITS :], np.array([counts[k] for k in languages], np.float64))


SPANS = ArrayType(StructType().add("lang", StringType()).add("first", IntegerType()).add("n", IntegerType()))
_models: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, spans): language and spans of every whole text, from the text alone.

    The columns ``carry`` come along under their names; the prediction doesn't read them.

    spans: array of (lang, first, n): n words, counted among the words of letters, from number first on. A text that is
    null or has no letter is UNKNOWN with score 0 and no spans. Ties go to the language first in the alphabet. Repeated
    rows give repeated results, an empty table an empty result; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((f"{id(model)}-{np.abs(model.table).sum()}", model))

    def run(batches):
        key, fitted = held.value
        if key not in _models:
            _models.clear()
            _models[key] = fitted
        of = _models[key]
        names = pa.array([*of.languages, UNKNOWN])
        for batch in batches:
            for begin, end, *_ in text_chunks(batch, 0, 2 << 20):
                texts = batch.column(0).slice(begin, end - begin).to_pylist()
                split = [letter_words(t or "") if of.languages else [] for t in texts]
                label, firsts = of.label(split)
                letters = np.fromiter((len(w) for t in split for w in t), np.float64, len(label))
                row = np.repeat(np.arange(len(texts)), np.diff(firsts))
                mass = np.zeros((len(texts), max(len(of.languages), 1)))
                np.add.at(mass, (row, label), letters)
                best = mass.argmax(1)
                share = mass[np.arange(len(texts)), best] / np.maximum(mass.sum(1), 1)
                empty = np.diff(firsts) == 0
                head = np.ones(len(label), bool)
                head[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(head)
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(at, firsts).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [names.take(pa.array(label[at])), pa.array((at - firsts[row[at]]).astype(np.int32)), pa.array(np.diff(np.append(at, len(label))).astype(np.int32))],
                        ["lang", "first", "n"],
                    ),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(begin, end - begin) for k in places),
                        names.take(pa.array(np.where(empty, len(of.languages), best))),
                        pa.array(np.where(empty, 0.0, share)),
                        spans,
                    ],
                    [*carried, "lang_pred", "score", "spans"],
                )

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(carry)))
    carried, places = rows.columns[1:], range(1, len(rows.columns))
    schema = StructType(rows.schema.fields[1:]).add("lang_pred", StringType()).add("score", DoubleType()).add("spans", SPANS)
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_{k}": c for k, c in enumerate(carry)})


def keep_known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs that are in one language, with all their columns; lang_col becomes the predicted language.

    Null texts and those without a letter go, and such of which no language holds the share ``least`` of the letters. If the
    model knows no language nothing is told: every text with a letter stays with the language that it came with.
    """
    # Under plain names no column of docs clashes with the operator's own.
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = dict(zip(docs.columns, names))
    out = identify(docs.toDF(*names), model, plain[id_col], plain[text_col], carry=tuple(names))
    if not model.languages:
        out = out.filter(F.col(plain[text_col]).rlike(r"\p{L}"))
        return out.select(*(F.col(n).alias(c) for c, n in plain.items()))
    out = out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return out.select(*(F.col("lang_pred" if c == lang_col else n).alias(c) for c, n in plain.items()))


def held_out(id_col: str = "doc_id"):
    """Documents that no model may learn from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(docs: DataFrame) -> DataFrame:
    out = identify(docs, fit(docs.filter(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
