"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Words are runs of letters and digits, lower-cased. A spot is a content word right after a common
word (or the first content word of a text); its signature is the chain of ``CHAIN`` content words
from there on, skipping common words. A document's fingerprint is its set of signatures; the string
form is a 128-bit digest of the sorted set. Two fingerprints are alike by the Jaccard coefficient,
which set lengths alone bound: sets of lengths a <= b reach at most a / b, so only length classes
that can reach a threshold need comparing (``near_fingerprints``).

Everything is DataFrame code over whole texts. Neighbours in the order of ids are found in one
shuffle of the texts: documents go to ranges of ids, each range's first document also to the range
before it, and a window inside the range sees the next document.

Defined cases: a null text is empty; a text without words has an empty fingerprint, and two empty
ones are alike (1.0); a text of common words only has one signature, of them all; ids descend, nulls
come last, equal ids follow by a hash of the text; one document is its own neighbour; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise, narrow

CHAIN = 2
DENSITY = 8
ROWS_PER_RANGE = 200
MAX_RANGES = 65_536

# Common words of English, French, German and Spanish.
COMMON_WORDS = """
a an and are as at be by for from has he in is it its of on or she that the they this to was were
which will with you
au aux avec ce ces dans de des du elle en est et il ils la le les mais ne nous on ou par pas pour
qu que qui sa se ses son sur un une vous
auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht sich sie
sind und von vor wie wir zu zum zur
al como con de del el ella en es esta este la las lo los me mi más no o para pero por que se sin
su sus un una y ya
""".split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def with_signatures(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the distinct signatures of ``text``, sorted."""
    w, at, spot = f"{name}_words", f"{name}_at", f"{name}_spots"
    keep = list(df.columns)
    common = sorted(set(COMMON_WORDS))
    df = df.select(*keep, words(text).alias(w))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>"))
    df = df.select(*keep, w, F.filter(
        upto(F.size(w)), lambda i: ~F.get(w, i).isin(common)).alias(at))
    df = df.select(*keep, w, at, F.filter(
        upto(F.size(at)),
        lambda k: (k == 0) | (F.get(at, k) - F.get(at, k - 1) > 1)
        | (F.pmod(F.xxhash64(F.get(w, F.get(at, k))), F.lit(DENSITY)) == 0)).alias(spot))
    chains = F.transform(F.col(spot), lambda k: F.xxhash64(
        *[F.get(w, F.get(at, k + j)) for j in range(CHAIN)]))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(
        F.array().cast("array<long>"))
    found = F.when(F.size(at) > 0, chains).otherwise(whole)
    return df.select(*keep, F.sort_array(F.array_distinct(found)).alias(name))


def digest(signatures: Column) -> Column:
    """The fingerprint as 32 hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), signatures)), 16, "0")
                              for seed in (1, 2)]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two fingerprints."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / union)


def length_class(signatures: Column, threshold: float) -> Column:
    """Sets whose likeness can reach the threshold are of the same class or of neighbouring ones."""
    # the small shift keeps sizes that are powers of 1 / threshold off the edges of the classes
    size = F.ln(F.greatest(F.size(signatures), F.lit(1)))
    return F.floor(size / F.ln(F.lit(1 / threshold)) + 1e-9).cast("int")


def _ranges_before(ids: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most the id, by binary search."""
    if not splits:
        return F.lit(0)
    bounds = F.array(*[F.lit(s) for s in splits]).cast("array<long>")
    steps = len(splits).bit_length()
    start = F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"] + 1) / 2).cast("int")
        right = (s["low"] < s["high"]) & (ids >= F.get(bounds, mid - 1))
        left = (s["low"] < s["high"]) & ~right
        return F.struct(F.when(right, mid).otherwise(s["low"]).alias("low"),
                        F.when(left, mid - 1).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows with signatures, and next_text and next_signatures of the row that
    follows by descending doc_id; the first row follows the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    n = max(1, min(MAX_RANGES, -(-docs.count() // ROWS_PER_RANGE)))
    probs = [i / n for i in range(1, n)]
    splits = []
    if probs:
        # at most MAX_RANGES ids; they only cut the work, never the result
        found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), probs, 20 * n)).first()[0]
        splits = sorted(set(found or []))
    bucket = F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(
        len(splits) - _ranges_before(F.col("doc_id").cast("long"), splits))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # one row for each range: its first document, and the range that it follows
    first = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_key")).alias("first"))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    first = materialise(first.select(
        F.col("first.doc_id").alias("f_id"), F.col("first.text_key").alias("f_key"),
        F.coalesce(F.lag("bucket").over(order), last).alias("ahead")), "ranges")
    placed = rows.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("f_id"))
                       & (F.col("text_key") == F.col("f_key")), "left")
    copies = F.filter(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")),
                              F.struct(F.col("ahead").alias("bucket"), F.lit(True).alias("guest"))),
                      lambda x: x["bucket"].isNotNull())
    placed = (placed.select("doc_id", "text", "text_key", F.explode(copies).alias("to"))
              .select("doc_id", "text", "text_key", "to.bucket", "to.guest"))
    keys = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("text_key").desc()]
    placed = placed.repartition("bucket").sortWithinPartitions(*keys)
    signed = with_signatures(placed, F.col("text"), "signatures")
    after = Window.partitionBy("bucket").orderBy(*keys[1:])
    return (signed.withColumn("next_text", F.lead("text").over(after))
            .withColumn("next_signatures", F.lead("signatures").over(after))
            .filter(~F.col("guest"))
            .select("doc_id", "text", "signatures", "next_text", "next_signatures"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
                      ) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last third replaced from the next document),
    signatures, edited_signatures, near_edited, near_next for every input row."""
    rows = with_next(narrow(docs, doc_id=id_col, text=text_col))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third),
                      F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       edited.alias("edited"), "signatures",
                       likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"))
    rows = with_signatures(rows, F.col("edited"), "edited_signatures")
    return rows.withColumn("near_edited", likeness(F.col("signatures"), F.col("edited_signatures")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, signatures and fingerprint of every input row."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    signed = with_signatures(rows, F.coalesce("text", F.lit("")), "signatures")
    return signed.select("doc_id", "signatures", digest(F.col("signatures")).alias("fingerprint"))


def _fingerprint_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fingerprint, signatures, copies: one row for each distinct fingerprint."""
    signed = fingerprints(docs, id_col, text_col)
    return signed.groupBy("fingerprint").agg(F.first("signatures").alias("signatures"),
                                             F.count(F.lit(1)).alias("copies"))


def _rare_first(classes: DataFrame, frequent: DataFrame) -> DataFrame:
    """``classes`` with ``ordered``: the signatures that are not frequent, then the others by count."""
    held = (classes.select("fingerprint", F.explode("signatures").alias("signature"))
            .join(frequent, "signature").groupBy("fingerprint")
            .agg(F.sort_array(F.collect_list(F.struct("holders", "signature"))).alias("held")))
    late = F.coalesce(F.col("held.signature"), F.array().cast("array<long>"))
    return classes.join(held, "fingerprint", "left").select(
        *classes.columns, F.concat(F.array_except("signatures", late), late).alias("ordered"))


def _index_entries(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """fingerprint, size, signature, length_class: a set's rarest signatures, so many that a set at the
    threshold shares one of them."""
    size = F.size("signatures")
    needed = F.ceil(size * threshold.numerator / F.lit(threshold.denominator)).cast("int")
    return classes.select(
        "fingerprint", size.alias("size"),
        length_class(F.col("signatures"), float(threshold)).alias("length_class"),
        F.explode(F.slice("ordered", F.lit(1), size - needed + 1)).alias("signature"))


def near_fingerprints(queries: DataFrame, docs: DataFrame, threshold: str = "0.8",
                      frequent_share: int = 1000, salts: int = 16, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """query, fingerprint, copies, likeness: for each distinct fingerprint of ``queries`` the distinct
    fingerprints of ``docs`` whose likeness is at least the threshold, and the number of rows of
    ``docs`` that have them. ``fingerprints`` tells which rows those are.

    Signatures held by more than 1 / ``frequent_share`` of the classes (at most ``frequent_share``
    times the mean set length of them) are counted as frequent and indexed only where a set has too
    few others. Index entries meet in the partition of their signature, length class and salt;
    pairs whose lengths cannot reach the threshold are pruned there, and the rest are compared
    exactly. The salt splits a signature that very many sets hold; a query goes to every salt.

    Defined cases: empty fingerprints are alike to each other only; a fingerprint is alike (1.0) to
    itself where ``docs`` has it; empty tables give an empty result.
    """
    t = Fraction(threshold)
    index = materialise(_fingerprint_classes(docs, id_col, text_col), "fingerprints")
    asked = materialise(_fingerprint_classes(queries, id_col, text_col), "queries")
    total = index.count()
    frequent = materialise(
        index.select(F.explode("signatures").alias("signature"))
        .groupBy("signature").agg(F.count(F.lit(1)).alias("holders"))
        .filter(F.col("holders") * frequent_share > total), "frequent")
    entries = _index_entries(_rare_first(index, frequent), t).withColumn(
        "salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).cast("int"))
    probes = _index_entries(_rare_first(asked, frequent), t).select(
        F.col("fingerprint").alias("query"), F.col("size").alias("query_size"), "signature",
        F.explode(F.array(*[F.col("length_class") + d for d in (-1, 0, 1)])).alias("length_class")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    possible = F.least("size", "query_size") * t.denominator >= F.greatest("size", "query_size") * t.numerator
    met = (entries.join(probes, ["signature", "length_class", "salt"]).filter(possible)
           .select("query", "fingerprint").filter("query != fingerprint").distinct())
    mine = asked.select(F.col("fingerprint").alias("query"), F.col("signatures").alias("query_signatures"))
    common = F.size(F.array_intersect("signatures", "query_signatures"))
    union = F.size("signatures") + F.size("query_signatures") - common
    found = (met.join(index, "fingerprint").join(mine, "query")
             .filter(common * t.denominator >= union * t.numerator)
             .select("query", "fingerprint", "copies",
                     likeness(F.col("signatures"), F.col("query_signatures")).alias("likeness")))
    same = index.join(asked.select("fingerprint"), "fingerprint").select(
        F.col("fingerprint").alias("query"), "fingerprint", "copies", F.lit(1.0).alias("likeness"))
    return found.unionAll(same)
