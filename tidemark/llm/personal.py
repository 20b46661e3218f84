"""Personal data, and the terms that reveal it, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected
entity. Information-theoretic sanitisation: the words of the documents that mention an entity are counted
over the corpus, and a word whose pointwise mutual information with the entity comes close to the entity's
own information content gives the entity away. Such terms are generalised wherever they stand in a document
with the entity, or removed if they reveal nearly all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import bound, chunks, column, documents, hot_lookup, prefix_sums
from tidemark.llm.registry import query
from tidemark.llm.spans import add_spans, joined, kind_count
from tidemark.sources.staging import stage

KINDS = ("email", "ip", "card", "phone", "term")
BASE = 4
DISCLOSES = 0.8  # share of the entity's information from which on a term is generalised
REVEALS = 0.95  # and from which on it is removed
WORDS = 1024  # words of a text looked up in one fold
CONTEXTS = 2  # different texts, or surroundings next to it, in which a term must stand by the entity; copies count once

# fixed values: what is searched. Possessive forms and the tests before them change no match; they keep
# long runs of one class linear (\G: a match may start where the last one ended)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn test?"""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_ip(value: Column) -> Column:
    return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}")


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """(_uid, doc_id, found, text): base spans (rank, start, end, value, before, after) that pass their tests.

    ``text`` is kept for rows with spans only.
    """
    rows = docs.select(column("doc_id").alias("doc_id"), F.coalesce(column("text"), F.lit("")).alias("text"))
    rows = add_spans(rows, "text", EMAIL, "email", F.contains("text", F.lit("@")))
    rows = add_spans(rows, "text", IP, "ip", F.contains("text", F.lit(".")))
    rows = add_spans(rows, "text", CARD, "card")
    rows = add_spans(rows, "text", PHONE, "phone", F.contains("text", F.lit("+")))

    def kept(rank: int, test) -> Column:
        passed = F.filter(F.col(KINDS[rank]), lambda s: test(s["value"]))
        names = ("start", "end", "value", "before", "after")
        return F.transform(passed, lambda s: F.struct(F.lit(rank).alias("rank"), *[s[n].alias(n) for n in names]))

    found = F.concat(
        kept(0, lambda v: F.length(v) > 0), kept(1, _is_ip), kept(2, _is_card), kept(3, _is_phone)
    )
    rows = rows.select(F.monotonically_increasing_id().alias("_uid"), "doc_id", found.alias("found"), "text")
    return rows.withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): documents in which each lower-cased word occurs; combined per task before the shuffle."""
    return docs.select(F.explode(_words(column("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def nearby_terms(mentions: DataFrame) -> DataFrame:
    """(_uid, entity, context, term, start, end): whole words of three letters or more next to a mention."""
    context = F.xxhash64(F.lower("before"), F.lower("after"))
    sides = mentions.select("_uid", "entity", context.alias("context"), "start", "end", "before", "after")
    sides = add_spans(sides, "before", WORD, "left_words")
    sides = add_spans(sides, "after", WORD, "right_words")
    before_at = F.col("start") - F.length("before")
    left = F.transform(
        # the first word of a full context may have been cut
        F.filter("left_words", lambda s: (s["start"] > 0) | (F.length("before") < 64)),
        lambda s: F.struct(F.lower(s["value"]).alias("term"), (before_at + s["start"]).alias("start"), (before_at + s["end"]).alias("end")),
    )
    right = F.transform(
        F.filter("right_words", lambda s: (s["end"] < F.length("after")) | (F.length("after") < 64)),
        lambda s: F.struct(F.lower(s["value"]).alias("term"), (F.col("end") + s["start"]).alias("start"), (F.col("end") + s["end"]).alias("end")),
    )
    each = sides.select("_uid", "entity", "context", F.explode(F.concat(left, right)).alias("t"))
    return each.select("_uid", "entity", "context", "t.*").filter(F.length("term") >= 3)


def whole_terms(mentions: DataFrame, texts: DataFrame, df: DataFrame, total: int, discloses: float, contexts: int) -> DataFrame:
    """(entity, term, _uid, copy): words of three letters or more of each whole document that mentions an entity.

    Left out is only what cannot disclose, or stands in one text alone, where the mention's surroundings decide: entities
    in one text, terms in one document, and terms in more than n * (of_entity / n)^discloses of the n documents.
    ``copy``: hash of the text.
    """
    least = min(contexts, 2)
    texts = texts.select("_uid", "text", F.xxhash64(F.lower("text")).alias("copy"))
    pairs = stage(mentions.select("entity", "_uid").distinct().join(texts.select("_uid", "copy"), "_uid"), "entity_texts")
    # copies are counted first, so that an entity in many documents is summed up in every task
    per_copy = pairs.groupBy("entity", "copy").agg(F.count(F.lit(1)).alias("rows"))
    counts = per_copy.groupBy("entity").agg(F.sum("rows").alias("of_entity"), F.count(F.lit(1)).alias("copies"))
    n = float(max(total, 1))
    most = F.lit(n) * F.pow(F.col("of_entity") / n, F.lit(discloses)) * (1 + 1e-9)
    entities = stage(counts.filter(F.col("copies") >= least).select("entity", "of_entity", most.alias("most")), "entities")
    highest = entities.agg(F.max("most").alias("m")).first().m
    pairs = hot_lookup(pairs, entities, "entity", "of_entity", pairs.count()).select("_uid", "copy", "entity", "most")
    pairs = stage(pairs, "repeated_entities")
    wanted = pairs.groupBy("_uid").agg(F.max("most").alias("_most"))
    words = texts.join(wanted, "_uid").select("_uid", "_most", F.explode(_words(F.col("text"))).alias("term"))
    words = stage(words.filter(F.length("term") >= 3), "entity_words")
    rare = df.filter((F.col("df") >= least) & (F.col("df") <= F.lit(highest)))
    used = words.groupBy("term").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= least)
    rare = stage(rare.join(used, "term"), "rare_terms")
    words = hot_lookup(words, rare, "term", "uses", words.count()).filter("df <= _most").select("_uid", "term", "df")
    return words.join(pairs, "_uid").filter("df <= most").select("entity", "term", "_uid", "copy")


def held_terms(
    near: DataFrame, mentions: DataFrame, texts: DataFrame, df: DataFrame, total: int, discloses: float = DISCLOSES, contexts: int = CONTEXTS
) -> DataFrame:
    """(entity, term, _uid, copy, context): terms of a document with the entity; by whole text (copy) or next to a mention (context)."""
    none = F.lit(None).cast("long")
    whole = whole_terms(mentions, texts, df, total, discloses, contexts)
    beside = near.select("entity", "term", "_uid", "context").distinct()
    return whole.withColumn("context", none).unionByName(beside.withColumn("copy", none))


def disclosure(held: DataFrame, mentions: DataFrame, df: DataFrame, total: int, discloses: float = DISCLOSES, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, ratio, both): PMI of term and entity as a share of the entity's information content, from ``discloses`` on."""
    # distinct surroundings, texts and documents, each combined in every task before the shuffle
    kinds = ("context", "copy", "_uid")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("id")) for i, c in enumerate(kinds)]))
    each = held.select("entity", "term", keys.alias("k")).filter("k.id IS NOT NULL").distinct()
    counts = [F.count_if(F.col("k.kind") == i).alias(c) for i, c in enumerate(("near", "copies", "both"))]
    pairs = each.groupBy("entity", "term").agg(*counts)
    pairs = pairs.filter(F.greatest("near", "copies") >= contexts)
    entities = mentions.select("entity", "_uid").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    known = stage(pairs.join(entities, "entity"), "pairs").join(df, "term")
    n = F.lit(float(max(total, 1)))
    pmi = F.log2(n * F.col("both") / (F.col("of_entity") * F.col("df")))
    information = F.log2(n / F.col("of_entity"))
    ratio = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    return known.select("entity", "term", ratio.alias("ratio"), "both").filter(F.col("ratio") >= discloses)


def term_places(found: DataFrame, marks: DataFrame) -> DataFrame:
    """(_uid, start, end, action): every place of a document's ``marks`` (_uid, term, action) outside its base spans."""
    actions = F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_actions")
    rows = found.join(marks.groupBy("_uid").agg(actions), "_uid").select("_uid", "found", "text", "_actions")
    words = F.zip_with(
        F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lambda gap, word: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(word), F.lit(0)).alias("size"), F.lower(word).alias("term")),
    )
    places = F.array().cast("array<struct<start:bigint,end:bigint,action:string>>")

    def step(acc, w):  # one pass over the words; only places of marked ones are kept
        start, action = acc["at"] + w["gap"], F.try_element_at("_actions", w["term"])
        place = F.struct(start.alias("start"), (start + w["size"]).alias("end"), action.alias("action"))
        met = F.when(action.isNull(), acc["met"]).otherwise(F.concat(acc["met"], F.array(place)))
        return F.struct((start + w["size"]).alias("at"), met.alias("met"))

    def fold(piece):
        return F.aggregate(piece, F.struct(F.lit(0).cast("long").alias("at"), places.alias("met")), step)

    # each chunk of words is a fold of its own, so no long array is copied word by word
    rows = rows.withColumn("_folds", bound(words, lambda w: F.transform(chunks(w, WORDS), fold)))
    rows = rows.withColumn("_ends", prefix_sums(F.transform("_folds", lambda f: f["at"])))
    each = rows.select("_uid", F.posexplode("_folds").alias("_i", "_f"), "_ends")
    moved = F.get("_ends", F.col("_i")) - F.col("_f.at")
    each = each.select("_uid", moved.alias("_by"), F.explode("_f.met").alias("s"))
    met = each.select("_uid", (F.col("s.start") + F.col("_by")).alias("start"), (F.col("s.end") + F.col("_by")).alias("end"), "s.action")
    # free of base spans: those that start before a place end there, those after start behind it
    base = rows.select("_uid", F.explode("found").alias("b")).select("_uid", "b.start", "b.end", F.lit(None).cast("string").alias("action"))
    order = W.partitionBy("_uid").orderBy("start", "end")
    is_base = F.col("action").isNull()
    both = met.unionByName(base)
    both = both.withColumn("_until", F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1)))
    both = both.withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing)))
    free = (F.coalesce("_until", "start") <= F.col("start")) & (F.coalesce("_next", "end") >= F.col("end"))
    return both.filter(~is_base & free).select("_uid", "start", "end", "action")


def personal_spans(docs: DataFrame, discloses: float = DISCLOSES, reveals: float = REVEALS, contexts: int = CONTEXTS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, all_spans.

    ``all_spans``: (rank, start, end, action), action mask for base spans, generalise or remove for terms.
    Null texts count as empty; repeated rows are reported each; extra columns are ignored. Words and
    entities are counted over all documents.
    """
    found = stage(base_spans(docs), "personal")
    total = found.count()
    mentions = found.filter(F.size("found") > 0).select("_uid", F.explode("found").alias("s"))
    entity = F.concat_ws(":", "s.rank", F.lower("s.value"))
    mentions = mentions.select("_uid", entity.alias("entity"), "s.start", "s.end", "s.before", "s.after")
    near = stage(nearby_terms(mentions), "near")
    texts = found.filter(F.size("found") > 0)
    df = stage(document_frequency(docs), "document_frequency")
    held = stage(held_terms(near, mentions, texts, df, total, discloses, contexts), "held_terms")
    key = F.concat_ws("|", "entity", "term").alias("pair")
    table = stage(disclosure(held, mentions, df, total, discloses, contexts).select(key, "ratio", "both"), "disclosing")
    of = held.select("_uid", "term", key).distinct()
    met = hot_lookup(of, table, "pair", "both", held.count())
    action = F.when(F.col("ratio") >= reveals, "remove").otherwise("generalise")
    marks = met.select("_uid", "term", action.alias("action")).groupBy("_uid", "term").agg(F.max("action").alias("action"))
    marks = stage(marks, "marks")
    beside = near.select("_uid", "term", "start", "end").join(marks, ["_uid", "term"]).select("_uid", "start", "end", "action")
    met = term_places(texts, marks).unionByName(beside)  # a word cut by a base span stands only beside it
    met = met.groupBy("_uid", "start", "end").agg(F.max("action").alias("action"))
    span = F.struct(F.lit(4).alias("rank"), "start", "end", "action")
    terms = met.groupBy("_uid").agg(F.collect_list(span).alias("terms"))
    base = F.transform(
        "found",
        lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")),
    )
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,action:string>>")
    rows = found.select("_uid", "doc_id", base.alias("base")).join(terms, "_uid", "left")
    rows = rows.withColumn("all_spans", F.concat("base", F.coalesce("terms", none)))
    return rows.select(
        "doc_id",
        *[kind_count(F.col("base"), i).alias(f"n_{KINDS[i]}") for i in range(BASE)],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all_spans"), KINDS).alias("spans"),
        kind_count(F.col("all_spans"), 4).alias("n_term"),
        "all_spans",
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: ``[kind]``, and nothing for removed terms; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["action"].alias("action"))))

    def step(acc, s):
        put = F.when(s["action"] == "remove", F.lit("")).otherwise(names[s["rank"]])
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(F.concat(acc["out"], gap, put).alias("out"), s["end"].alias("at"))
        )

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


@query("op10_personal")
def op10_personal(spark, sf_dir):
    return personal_spans(documents(spark, sf_dir)).drop("all_spans")
