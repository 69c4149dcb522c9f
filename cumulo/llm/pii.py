"""Personal data: pattern spans, and terms that give a protected entity away by how they occur with it.

Every personal datum found by pattern is a protected entity e.  A term t of a document that holds e discloses
log2(P(e | t) / P(e)) bits of the log2(1 / P(e)) that knowing e is worth; the estimates come from document counts over the whole
corpus, smoothed so that a rare pair is judged by the same thresholds with less confidence.  In documents that hold e, terms that
disclose most of it are removed, terms that disclose much of it are generalised to a beginning that too many documents share
to disclose e.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.spans import LOWER, SPAN, UPPER, apart, count, joined, replaced, spans, where_present
from cumulo.plans.shared import materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive and anchored at the start of a run, which finds the same matches as the plain patterns in linear time:
# a later start in the same run fails as the first did.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_RUN = r"[\p{L}\p{N}]"
PLACES = "array<struct<start:int,rank:int,end:int,kind:string,value:string,left:int>>"
#: Beginnings are tried up to this length first; only terms that may keep all of it go on to twice the length, and so on.
FIRST_BEGINNINGS = 32
SALTS, NEAR_SALTS = 32, 8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0))),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(s: Column) -> Column:
    n = F.length(_digits(s["value"]))
    return (
        F.when(s["kind"] == "ip", F.forall(F.split(s["value"], r"\."), _byte))
        .when(s["kind"] == "card", n.between(14, 19) & _luhn(_digits(s["value"])))
        .when(s["kind"] == "phone", n.between(10, 15))
        .otherwise(True)
    )


def base_spans(text: Column) -> Column:
    """The pattern spans of a text without nulls, by start and then kind."""
    some_digit = text.rlike("[0-9]")
    found = F.concat(
        where_present(spans(text, "email", 0, EMAIL), F.contains(text, F.lit("@"))),
        where_present(spans(text, "ip", 1, IP), some_digit & F.contains(text, F.lit("."))),
        where_present(spans(text, "card", 2, CARD), text.rlike("[0-9](?:[ -]?[0-9]){13}")),
        where_present(spans(text, "phone", 3, PHONE), F.contains(text, F.lit("+"))),
    )
    return F.sort_array(F.filter(found, _passes))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.translate(s["value"], UPPER, LOWER)))


def _terms(text: Column) -> Column:
    """The different runs of letters and digits, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(_RUN + "+"), F.lit(0)))


def _share(both: Column, term: Column, entity: Column, total: int, prior: float) -> Column:
    """Share of an entity's information that a term discloses, from document counts.

    P(e | t) is estimated as (n(t,e) + prior P(e)) / (n(t) + prior): ``prior`` documents stand in as if t said nothing about e.
    """
    p = entity / F.lit(float(total))
    return F.log2((both + F.lit(prior) * p) / (term + F.lit(prior)) / p) / -F.log2(p)


def _most(entity: Column, total: int, prior: float, generalise: float) -> Column:
    """The largest n(t) with which a share can reach ``generalise``, for an entity's count; it rises with that count."""
    p = entity / F.lit(float(total))
    return (entity + F.lit(prior) * p) * F.pow(p, F.lit(generalise - 1)) - F.lit(prior)


def _key(id_col: str, text: Column) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), text)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, h, text, entities, terms)`` of each document with personal data; terms are those outside of the pattern spans."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = own.select(_key(id_col, F.col("text")).alias("h"), "text", base_spans(F.col("text")).alias("found")).where("size(found) > 0")
    entities = F.array_distinct(F.transform("found", _entity))
    plain = replaced(F.col("text"), F.col("found"), lambda s: F.lit(" "))
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "h", "text", entities.alias("entities"), _terms(plain).alias("terms")), "mentions")


def held_entities(met: DataFrame, total: int) -> DataFrame:
    """``(row, entity, n_e)``: entities that stand in exactly the same documents are one, named by the least of them, so a list of
    thousands of addresses counts as one entity of its document.  An entity in every document has nothing to disclose.
    """
    held = met.select("row", F.explode("entities").alias("entity"))
    places = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("places")
    sets = held.groupBy("entity").agg(F.count("*").alias("n_e"), places).where(F.col("n_e") < total)
    named = sets.join(sets.groupBy("n_e", "places").agg(F.min("entity").alias("least")), ["n_e", "places"])
    # An entity may stand in a third of all documents: its rows are dealt over salts, its name goes to each of them.
    held = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(NEAR_SALTS)))
    met_again = held.join(_salted(named, NEAR_SALTS), ["entity", "salt"])
    return materialize(met_again.select("row", F.col("least").alias("entity"), "n_e").distinct(), "entities")


def _salted(df: DataFrame, n: int) -> DataFrame:
    """``df`` once for each of ``n`` salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))


def beginnings(disclosing: DataFrame, everywhere: DataFrame, total: int, prior: float, generalise: float) -> DataFrame:
    """``(entity, term, kept)``: how many characters of a term may stay.

    The longest beginning that some term of the corpus has which stands in so many documents that even if all documents of
    the entity were among them, it would disclose less than ``generalise``.  Terms that stand in too few documents to make a
    beginning safe even for an entity of one document are left out before their beginnings are made, which changes nothing.
    """
    enough = everywhere.where(F.col("n_t") > _most(F.lit(1.0), total, prior, generalise))
    open_ = disclosing.where("NOT removed AND length(term) > 1").select("entity", "term", "n_e")
    found, least, most = [], 1, FIRST_BEGINNINGS
    while True:
        # Longer beginnings are rarer, so a term that may not keep ``most`` characters may keep no more.
        kept = materialize(_kept(open_, enough, least, most, total, prior, generalise), "beginnings")
        found.append(kept.drop("n_e"))
        open_ = kept.where(f"kept = {most} AND length(term) > {most + 1}").select("entity", "term", "n_e")
        if open_.isEmpty():
            return reduce(DataFrame.union, found).groupBy("entity", "term").agg(F.max("kept").alias("kept"))
        least, most = most + 1, 2 * most


def _kept(tried: DataFrame, enough: DataFrame, least: int, most: int, total: int, prior: float, generalise: float) -> DataFrame:
    """``(entity, term, n_e, kept)`` of the terms that may keep a beginning of ``least`` to ``most`` characters."""
    lengths = lambda n: F.explode(F.filter(F.sequence(F.lit(least), F.greatest(F.least(n, F.lit(most)), F.lit(least))), lambda k: k <= n))
    tried = tried.select("*", lengths(F.length("term") - 1).alias("k")).withColumn("start", F.expr("substring(term, 1, k)"))
    starts = enough.select("term", "n_t", lengths(F.length("term")).alias("k")).select(F.expr("substring(term, 1, k)").alias("start"), "n_t")
    common = starts.join(tried.select("start").distinct(), "start", "left_semi").groupBy("start").agg(F.max("n_t").alias("n_s"))
    safe = _share(F.col("n_e"), F.col("n_s"), F.col("n_e"), total, prior) < generalise
    # The first letters of all terms are few: a beginning's terms are dealt over salts, its one row of counts to each of them.
    tried = tried.withColumn("salt", F.pmod(F.xxhash64("entity", "term"), F.lit(SALTS)))
    return tried.join(_salted(common, SALTS), ["start", "salt"]).where(safe).groupBy("entity", "term", "n_e").agg(F.max("k").alias("kept"))


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 10.0, generalise: float = 0.6, remove: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose at least ``generalise`` of an entity's information, as two tables.

    ``(entity, term, n_te, n_t, n_e, share, removed, kept)``, and ``(h, terms)`` of each document that holds such a term and
    its entity, h a hash of id and text, terms the places of such terms with the characters that each keeps, -1 if it is removed.  share is
    log2(P(e | t) / P(e)) / log2(1 / P(e)) with the smoothed estimate of :func:`_share`, over documents: n(t,e) those with both,
    n(t) those with t anywhere, n(e) those with e.  Every document counts, and every term in it, however far from the entity.
    A term too common to reach the threshold for any entity of its document leaves before the pairs are made, which loses none.
    """
    met = mentions(docs, id_col, text_col)
    total = docs.count()
    held = held_entities(met, total)
    spark = docs.sparkSession
    if held.isEmpty():
        none = spark.createDataFrame([], "entity string, term string, n_te long, n_t long, n_e long, share double, removed boolean, kept int")
        return none, spark.createDataFrame([], f"h long, terms {PLACES}")
    every = docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    everywhere = materialize(every, "everywhere")
    limits = held.groupBy("row").agg(F.max(_most(F.col("n_e"), total, prior, generalise)).alias("most"))
    rare = everywhere.where(F.col("n_t") <= (limits.agg(F.max("most")).first()[0] or 0))
    own = met.join(limits, "row").select("row", "h", "most", F.explode("terms").alias("term"))
    # A document's terms are dealt over salts and meet its entities in each of them.
    own = own.join(rare, "term").where("n_t <= most").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(NEAR_SALTS)))
    near = own.join(_salted(held, NEAR_SALTS), ["row", "salt"]).where(F.col("n_t") <= _most(F.col("n_e"), total, prior, generalise))
    near = materialize(near.select("h", "entity", "n_e", "term", "n_t"), "near")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e"))
    scored = pairs.withColumn("share", _share(F.col("n_te"), F.col("n_t"), F.col("n_e"), total, prior)).where(F.col("share") >= generalise)
    scored = materialize(scored.withColumn("removed", F.col("share") >= remove), "scored")
    kept = beginnings(scored, everywhere, total, prior, generalise)
    told = materialize(scored.join(kept, ["entity", "term"], "left").withColumn("kept", F.coalesce("kept", F.lit(0))), "disclosing")
    marked = near.join(told.select("entity", "term", F.when(F.col("removed"), -1).otherwise(F.col("kept")).alias("left")), ["entity", "term"])
    marked = materialize(marked.groupBy("h", "term").agg(F.min("left").alias("left")), "marked")
    return told, places(met, marked)


def places(met: DataFrame, marked: DataFrame) -> DataFrame:
    """``(h, terms)``: where the terms of ``marked`` (h, term, left) stand in their documents, sorted.

    A row a word of the different documents that have any; a running sum of lengths, within a document, gives each word's start.
    """
    held = met.select("h", "text").join(marked.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    runs = F.lit(_RUN + "+")
    both = F.arrays_zip(F.split("text", _RUN + "+", -1).alias("gap"), F.regexp_extract_all("text", runs, F.lit(0)).alias("hit"))
    words = held.select("h", F.posexplode(both).alias("n", "w")).select("h", "n", F.col("w.hit").alias("value"), (F.length("w.gap") + F.coalesce(F.length("w.hit"), F.lit(0))).alias("size"))
    end = F.sum("size").over(Window.partitionBy("h").orderBy("n")).cast("int")
    words = words.withColumn("end", end).where("value IS NOT NULL").withColumn("term", F.translate("value", UPPER, LOWER))
    found = words.join(marked, ["h", "term"])
    place = F.struct((F.col("end") - F.length("value")).alias("start"), F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"), "value", "left")
    return found.groupBy("h").agg(F.sort_array(F.collect_list(place)).cast(PLACES).alias("terms"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **thresholds: float) -> DataFrame:
    """``docs`` with ``pii_spans`` (start, rank, end, kind, value; code points, end exclusive) and ``pii_text``, the text without them.

    Spans are the pattern kinds and ``term``, sorted by start and then kind; a term counts only where it overlaps no
    pattern span, only in documents that hold the entity it discloses.  In the text a pattern span becomes [EMAIL], [IP], [CARD] or
    [PHONE], a term that discloses most nothing, a term that discloses much its beginning that doesn't (``Zan…``), or
    [TERM] where it has none.  Null text has no spans and stays null.  Rows with equal id and text are treated alike; null ids
    are fine.  Every row and column stays; columns of the two names are replaced.  ``thresholds`` are those of
    :func:`disclosing_terms`.  While at most ``broadcast_rows`` documents have terms, their hashes (8 bytes each) are broadcast and only
    those documents are shuffled to their terms; beyond that all are.
    """
    names = [c for c in docs.columns if c not in ("pii_spans", "pii_text")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = materialize(disclosing_terms(docs, id_col, text_col, **thresholds)[1], "terms-by-document")
    # The row travels as one struct, so no name of its own can clash with a helper's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("old"), text.alias("text"), _key(id_col, text).alias("h"))
    if each.count() <= broadcast_rows:
        known = F.broadcast(each.select("h"))
        others = rows.join(known, "h", "left_anti").withColumn("terms", F.lit(None).cast(PLACES))
        rows = rows.join(known, "h", "left_semi").join(each, "h").unionByName(others)
    else:
        rows = rows.join(each, "h", "left")
    rows = rows.withColumn("base", base_spans(F.col("text")))
    plain = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")], F.lit(None).cast("int").alias("left")))
    rows = rows.withColumn("found", F.when(F.col("terms").isNull(), plain).otherwise(F.sort_array(F.concat(plain, apart(F.col("terms"), F.col("base"))))))

    def label(s: Column) -> Column:
        general = F.when(s["left"] > 0, F.concat(F.substring(s["value"], F.lit(1), s["left"]), F.lit("…"))).otherwise(F.lit("[TERM]"))
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["left"] < 0, F.lit("")).otherwise(general)

    clean = F.when(F.size("found") > 0, replaced(F.col("old"), F.col("found"), label)).otherwise(F.col("old"))
    return rows.withColumn("clean", clean).select("row.*", F.transform("found", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])).cast(SPAN).alias("pii_spans"), F.col("clean").alias("pii_text"))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs).withColumn("base", F.filter("pii_spans", lambda s: s["kind"] != "term"))
    return found.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
