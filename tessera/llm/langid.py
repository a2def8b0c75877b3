"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word's score in a language is the log-likelihood of its character n-grams there, n = 1 to 4, over
n-gram counts of labelled texts. The script of a word leaves those languages whose own texts write words
in that script. Over a text's words, the best path of labels under a switching penalty gives spans of one
language each; the language of the most letters is the text's.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_AT_ONCE, map_batches, read_table, tune, unused

#: Bound of the training sample: about so many texts, and bytes of texts, of each language, picked by a hash of id and text.
TEXTS_A_LANGUAGE, BYTES_A_LANGUAGE = 400, 4 << 20
#: What a change of language within a text costs, in nats; a word speaks for no language by more than MOST.
SWITCH, MOST = 14.0, 6.0
#: Lengths of n-grams, added count, and share of a language's words that a script needs to be one of its own.
LENGTHS, ADDED, SCRIPT_SHARE = (1, 2, 3, 4), 0.5, 0.001
CACHE = 300_000
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, span_starts array<int>, span_langs array<string>"
#: Letters by Unicode category, with the marks that follow them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# First code point of each block of scripts, by name; "" are blocks without letters of one script.
SCRIPT_STARTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "tibetan"),
    (0x1000, "myanmar"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, ""),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, ""),
    (0xF900, "han"),
    (0xFB00, ""),
    (0x20000, "han"),
    (0x32000, ""),
)


def script(word: str) -> str:
    """Script of a word by its first letter."""
    at, name = ord(word[0]), ""
    for start, s in SCRIPT_STARTS:
        if at < start:
            break
        name = s
    return name


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1)]


class Model:
    """N-gram weights by language, learned from (text, language) pairs."""

    def __init__(self, pairs: list[tuple[str, str]]):
        words: dict[str, Counter] = defaultdict(Counter)
        for text, lang in pairs:
            words[lang].update(WORD.findall((text or "").lower()))
        self.langs = sorted(words)
        counts = [Counter() for _ in self.langs]
        self.scripts: dict[str, np.ndarray] = {}
        for k, lang in enumerate(self.langs):
            scripts: Counter = Counter()
            for word, n in words[lang].items():
                scripts[script(word)] += n
                for g in grams(word):
                    counts[k][g] += n
            for s, n in scripts.items():
                if n >= SCRIPT_SHARE * scripts.total():
                    self.scripts.setdefault(s, np.zeros(len(self.langs), bool))[k] = True
        known = sorted(set().union(*counts)) if counts else []
        self.rows = {g: i for i, g in enumerate(known)}
        # The last row is for n-grams never seen, which are as likely in each language.
        self.weights = np.zeros((len(known) + 1, len(self.langs)), np.float32)
        for k, c in enumerate(counts):
            total = defaultdict(int)
            kinds = Counter(map(len, known))
            for g, n in c.items():
                total[len(g)] += n
            for g, i in self.rows.items():
                self.weights[i, k] = math.log((c[g] + ADDED) / (total[len(g)] + ADDED * kinds[len(g)]))

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word below its best candidate's, from 0 to -MOST; languages of other scripts at -MOST."""
        rows, none = self.rows, len(self.rows)
        index, starts = [], []
        for w in words:
            starts.append(len(index))
            index += [rows.get(g, none) for g in grams(w)]
        # N-grams of different lengths overlap and say the same several times; half of their sum stands for it.
        s = np.add.reduceat(self.weights[index], starts, axis=0) / 2
        for i, w in enumerate(words):
            if not w.isascii() and (may := self.scripts.get(script(w))) is not None and not may.all():
                s[i, ~may] = -np.inf
        if (may := self.scripts.get("latin")) is None or not may.all():
            for i, w in enumerate(words):
                if w.isascii() and may is not None:
                    s[i, ~may] = -np.inf
        s -= s.max(1, keepdims=True)
        return np.maximum(s, -MOST)


def best_path(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Labels of the path with the highest sum of scores less a penalty for each change; ties: the lower label.

    If from one language no other gains more than the penalty over any stretch of words, then no path
    with changes that uses it is better than that language alone: its other stretches are no more than its
    changes. A path without it has a stretch more than changes, and gains at most each word's best other
    language in all; if that is no more than one penalty as well, Viterbi's steps are spared.
    """
    n, k = scores.shape
    main = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, np.int64)
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, main : main + 1], axis=0, out=gain[1:])
    without = np.delete(scores, main, axis=1).max(1).sum(dtype=np.float64) - scores[:, main].sum(dtype=np.float64)
    if without <= penalty and (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty:
        return np.full(n, main)
    back = np.empty((n, k), np.int64)
    value = scores[0].tolist()
    stay = list(range(k))
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(value)
        best = value.index(top)
        cut = top - penalty
        back[t] = [i if v >= cut else best for i, v in zip(stay, value)]
        value = [(v if v >= cut else cut) + s for v, s in zip(value, row)]
    out = np.empty(n, np.int64)
    at = value.index(max(value))
    for t in range(n - 1, -1, -1):
        out[t] = at
        if t:
            at = back[t, at]
    return out


class Labeller:
    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def rows(self, docs: list[list[str]]) -> None:
        lack = {w for words in docs for w in words if w not in self.index}
        if not lack:
            return
        if len(self.index) + len(lack) > CACHE:
            self.index.clear()
            lack = {w for words in docs for w in words}
        new, at = sorted(lack), len(self.index)
        if at + len(new) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), at + len(new)), len(self.model.langs)), np.float32)
            grown[:at] = self.table[:at]
            self.table = grown
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.table[at + k : at + k + len(part)] = self.model.score(part)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[int], list[str]]]:
        """(language, score, first word of each span, its language) of each text."""
        docs = [WORD.findall(t.lower()) if t else [] for t in texts]
        langs, out = self.model.langs, []
        if langs:
            self.rows(docs)
        for words in docs:
            if not words or not langs:
                out.append((UNKNOWN, 0.0, [], []))
                continue
            path = best_path(self.table[list(map(self.index.__getitem__, words))])
            letters = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(langs))
            main = int(letters.argmax())
            first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            out.append((langs[main], float(letters[main] / letters.sum()), first.tolist(), [langs[k] for k in path[first].tolist()]))
        return out


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows with a language that aren't held out, by a sample of about TEXTS_A_LANGUAGE texts of each.

    The sample takes rows by a hash of id and text, at a rate from a count of each language's rows and bytes,
    which covers all of them; rows with equal id and text are taken or left together. Null texts say nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).collect()
    rates = {r["lang"]: min(1.0, TEXTS_A_LANGUAGE / r["n"], BYTES_A_LANGUAGE / max(r["size"], 1)) for r in sizes}
    if not rates:
        return Model([])
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("lang")]
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < rate * 1_000_003
    return Model([(r["text"], r["lang"]) for r in rows.where(pick).select("text", "lang").collect()])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, and spans by their first word's number and language.

    The score is the share of the text's letters that stand in spans of lang_pred. Texts that are null or
    have no letter, and all texts under a model of nothing: und, 0 and no spans. Only id and text are read;
    null ids and repeated rows stay. No rows in: no rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(sent.value)

        def run(batch):
            lang, score, starts, langs = zip(*labeller.label(batch.column(1).to_pylist()), strict=True)
            return {"doc_id": batch.column(0), "lang_pred": list(lang), "score": list(score), "span_starts": list(starts), "span_langs": list(langs)}

        return run

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), SCHEMA, make)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language and a score of at least `least`, with all of their columns.

    A null language becomes the predicted one. Decided row by row, without a join.
    """
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for s in batches:
            found = [x[:2] for at in range(0, len(s), ROWS_AT_ONCE) for x in labeller.label(s.iloc[at : at + ROWS_AT_ONCE].tolist())]
            yield pd.DataFrame(found, columns=["lang", "score"])

    # Not deterministic, for the planner: the filter and the column after it are to read one evaluation.
    own = unused("told", docs)
    told = docs.withColumn(own, label.asNondeterministic()(F.col(text_col)))
    told = told.where((F.col(own)["lang"] != UNKNOWN) & (F.col(own)["score"] >= least))
    return told.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col(own)["lang"])).drop(own)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over documents: one row a document, whole texts; null texts and texts without a letter are `und`."""
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
