"""BM25 over a table of texts, document weights and query weights apart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import TOKEN, let, tokens
from lorespark.util.scratch import Scratch

K1, B = 1.5, 0.75


def query_terms(query: str | None) -> list[str]:
    """Distinct terms of a query in order, as tokens() cuts them."""
    return list(dict.fromkeys(t for t in re.findall(TOKEN, (query or "").lower()) if len(t) >= 2))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def term_counts(found: Column) -> Column:
    """Distinct terms of a list with their counts, array<struct<term, tf>>: the sorted list is cut where the term changes."""

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("int").alias("tf"))))

    return let(F.sort_array(found), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast("array<struct<term:string,tf:int>>")))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl). A document's terms lie in one row and are counted there: nothing is shuffled."""
    cut = docs.select(F.col(key), let(tokens(text), lambda t: F.struct(F.size(t).alias("dl"), term_counts(t).alias("terms"))).alias("_s"))
    return cut.select(key, F.col("_s.dl").alias("dl"), F.explode("_s.terms").alias("_t")).select(key, "_t.term", "_t.tf", "dl")


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row (n_docs, sum_dl, avgdl); documents without tokens count."""
    dl = F.size(tokens(text))
    n, s = F.count(F.lit(1)), F.coalesce(F.sum(dl), F.lit(0))
    return docs.agg(n.alias("n_docs"), s.alias("sum_dl"), F.when(n > 0, s / n).otherwise(0.0).alias("avgdl"))


def doc_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.when(avgdl > 0, k1 * (1 - b + b * dl / avgdl)).otherwise(F.lit(k1))
    return F.round(tf * (k1 + 1) / (tf + norm), 6)


def idf(df: Column, n_docs: Column) -> Column:
    raw = F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)
    return F.when((n_docs > 0) & (df > 0), F.round(F.greatest(F.lit(0.0), raw), 6)).otherwise(F.lit(0.0))


def doc_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight) of every document and term."""
    avgdl = corpus_stats(docs, text).select("avgdl").scalar()
    return postings(docs, key, text).select(key, "term", doc_weight(F.col("tf"), F.col("dl"), avgdl).alias("weight"))


def search(docs: DataFrame, key: str, text: str, query: str, limit: int | None = 10, keep: list[str] | None = None, idf_power: int = 1) -> DataFrame:
    """(key, keep…, score) of the best documents, greatest score first, then the least key; limit None gives all hits.

    The texts are scanned once and no postings are shuffled: each document is reduced, where it lies, to its length
    and its counts of the query's terms; the documents that hold a term are kept in a scratch table while the lengths
    and document frequencies of all are counted on the way. idf_power 2 weighs terms twice.
    """
    terms = query_terms(query)
    keep = keep or []
    if not terms:
        return docs.select(key, *keep, F.lit(0.0).alias("score")).limit(0)
    counted = lambda t: F.struct(F.size(t).alias("dl"), F.array(*[F.size(F.filter(t, _equals(x))) for x in terms]).alias("tf"))
    cut = docs.select(key, *keep, let(tokens(text), counted).alias("_s")).select(key, *keep, F.col("_s.dl").alias("_dl"), F.col("_s.tf").alias("_tf"))
    dfs = {f"d{i}": F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms))}
    hits, n = Scratch(docs.sparkSession).save_counting(cut, lambda df: df.where(F.exists("_tf", lambda x: x > 0)), n=F.count(F.lit(1)), dl=F.sum("_dl"), **dfs)
    avgdl = F.lit(n["dl"] / n["n"] if n["n"] else 0.0)
    parts = []
    for i in range(len(terms)):
        tf, weight = F.col("_tf")[i], idf(F.lit(n[f"d{i}"]), F.lit(n["n"]))
        parts.append(F.when(tf > 0, doc_weight(tf, F.col("_dl"), avgdl) * (weight if idf_power == 1 else weight * weight)).otherwise(F.lit(0.0)))
    scored = hits.select(key, *keep, F.round(sum(parts[1:], parts[0]), 6).alias("score")).orderBy(F.desc("score"), key)
    return (scored if limit is None else scored.limit(limit)).where("score > 0")


class Index:
    """Postings of a table of texts, written once: (key, term, tf, dl) in folders by a hash of the term, and the counts of the corpus.

    A search reads the folders of its terms only, and of these the parts that hold them; no text is looked at again. A
    frequent term is spread over several files of its folder. A null text has no terms and counts as a document.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, scratch: Scratch | None = None, buckets: int = 16):
        self.key, self.buckets = key, buckets
        cut = docs.select(F.col(key), let(tokens(text), lambda t: F.struct(F.size(t).alias("dl"), term_counts(t).alias("terms"))).alias("_s"))
        # as many parts of a folder as there are tasks for it
        files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
        bucket, part = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(key), F.lit(files))

        def flat(df: DataFrame) -> DataFrame:
            rows = df.select(key, F.col("_s.dl").alias("dl"), F.explode("_s.terms").alias("_t")).select(key, "_t.term", "_t.tf", "dl", bucket.alias("bucket"))
            return rows.repartition("bucket", part).sortWithinPartitions("bucket", "term")

        self.postings, n = (scratch or Scratch(docs.sparkSession)).save_counting(cut, flat, "bucket", n=F.count(F.lit(1)), dl=F.sum("_s.dl"))
        self.n_docs, self.sum_dl = n["n"], n["dl"]
        self.avgdl = self.sum_dl / self.n_docs if self.n_docs else 0.0

    def stats(self) -> DataFrame:
        """One row (n_docs, n_terms, sum_dl, avgdl)."""
        terms = self.postings.select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))
        return terms.select(F.lit(self.n_docs).cast("long").alias("n_docs"), "n_terms", F.lit(self.sum_dl).cast("long").alias("sum_dl"), F.round(F.lit(self.avgdl), 6).alias("avgdl"))

    def weights(self) -> DataFrame:
        """(key, term, weight) of every document and term."""
        return self.postings.select(self.key, "term", doc_weight(F.col("tf"), F.col("dl"), F.lit(self.avgdl)).alias("weight"))

    def idf(self) -> DataFrame:
        """(term, df, idf); terms of one document are in one row, so df counts documents."""
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.select("term", "df", idf(F.col("df"), F.lit(self.n_docs)).alias("idf"))

    def hits(self, terms: list[str]) -> DataFrame:
        """(key, term, tf, dl) of the given terms."""
        pruned = self.postings.where(F.col("bucket").isin(self._buckets(terms)) & F.col("term").isin(terms))
        return pruned.drop("bucket")

    def _buckets(self, terms: list[str]) -> list[int]:
        rows = self.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b"))
        return sorted({r.b for r in rows.collect()})

    def search(self, query: str, limit: int | None = 10) -> DataFrame:
        """(key, score) of the best documents, greatest score first, then the least key; limit None gives all hits."""
        terms = query_terms(query)
        if not terms:
            return self.postings.select(self.key, F.lit(0.0).alias("score")).limit(0)
        found = self.hits(terms)
        # one row for each term of the query
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = F.lit(0.0)
        for term, n in df.items():
            weight = F.when(F.col("term") == term, idf(F.lit(n), F.lit(self.n_docs))).otherwise(weight)
        scored = found.groupBy(self.key).agg(F.round(F.sum(doc_weight(F.col("tf"), F.col("dl"), F.lit(self.avgdl)) * weight), 6).alias("score"))
        scored = scored.where("score > 0").orderBy(F.desc("score"), self.key)
        return scored if limit is None else scored.limit(limit)


_kept: dict[tuple, Index] = {}


def index_of(docs: DataFrame, key: str, text: str) -> Index:
    """The Index of a table of files, made by the first call in an application and kept while the files stay as they are."""
    spark = docs.sparkSession
    state = []
    for name in sorted(docs.inputFiles()):
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        state.append((name, status.getLen(), status.getModificationTime()))
    known = spark.sparkContext.applicationId, key, text, tuple(state)
    if known not in _kept:
        _kept[known] = Index(docs, key, text)
    return _kept[known]
