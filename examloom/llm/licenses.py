"""License scans by diagonal voting (operator 4), in DataFrame functions only.

Every k consecutive words of a text form a gram with a rolling hash over the
words' hashes; it is joined to the grams of all templates.  A match at word p of
the text and word q of the template votes for the diagonal p - q.  Votes are
summed by diagonal, diagonals next to each other (an inserted or missing word)
are merged, and each merged span is verified: for a whole phrase every gram must
have voted on one single diagonal, for a longer notice ``MIN_COVER`` of its grams.

Inside each row, before anything is exploded, a sieve of bits over the
templates' hashes stops all grams that no template has.  The join carries the
gram itself, so that equal hashes of different words do not count.  Only
matching rows are shuffled, and they are pre-aggregated by diagonal.  The
templates are a constant of this module, hence broadcast with a known size.

Null or empty text: 0 words, no labels, score 0, null places.  Texts shorter
than a gram match nothing.  Rows are told apart by id and a hash of the text:
repeated and null ids are scanned like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known license notices, as published by their stewards.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "reserved": "all rights reserved",
}

PHRASE_K, NOTICE_K = 2, 3
MIN_COVER = 0.6
#: Diagonals at most this far apart are merged.
SLACK = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


#: Modulus and base of the rolling hash over the words' hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003
SIEVE_BITS = 1 << 14


def word_hash(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(PRIME))


def rolled(h: list[Column]) -> Column:
    """The rolling hash of consecutive words' hashes, from the first to the last."""
    out = h[0]
    for x in h[1:]:
        out = (out * F.lit(BASE) + x) % F.lit(PRIME)
    return out


def templates(spark) -> DataFrame:
    """One row per gram of each template: template, label, whether it is a phrase, number of grams, gram, its rolling hash and place."""
    rows = []
    for i, (label, text, k) in enumerate([*((v, p, PHRASE_K) for p, v in PHRASES.items()), *((v, t, NOTICE_K) for v, t in NOTICES.items())]):
        w = text.split()
        grams = [w[q : q + k] for q in range(len(w) - k + 1)]
        rows += [(i, label, k == PHRASE_K, len(grams), k, g, q) for q, g in enumerate(grams)]
    made = spark.createDataFrame(rows, "template int, label string, phrase boolean, n_grams int, k int, words array<string>, q int")
    h = F.when(F.col("k") == PHRASE_K, rolled([word_hash(F.get("words", F.lit(i))) for i in range(PHRASE_K)])).otherwise(rolled([word_hash(F.get("words", F.lit(i))) for i in range(NOTICE_K)]))
    return made.select("template", "label", "phrase", "n_grams", "k", F.concat_ws(" ", "words").alias("gram"), h.alias("h"), "q")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The words of every row (id, th, n_words), and the verified spans of its text (id, th, label, phrase, first, n, cover)."""
    made = templates(docs.sparkSession)
    known = F.broadcast(made.select("template", "label", "phrase", "n_grams", F.col("k").alias("tk"), F.col("gram").alias("tgram"), F.col("h").alias("th_"), "q"))
    # A sieve of bits over the templates' hashes: grams that it stops are in no template.
    bits: dict[int, set[int]] = {PHRASE_K: set(), NOTICE_K: set()}
    for r in made.select("k", "h").collect():
        bits[r.k].add(r.h % SIEVE_BITS)
    split = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), words_of(F.col(text)).alias("w"))
    hashed = split.select("id", "th", "w", F.transform("w", word_hash).alias("hs"))

    def grams(k: int) -> Column:
        places = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
        full = [0] * (SIEVE_BITS // 63 + 1)
        for b in bits[k]:
            full[b // 63] |= 1 << (b % 63)
        sieve = F.lit(full).cast("array<long>")

        def gram_hash(p: Column) -> Column:
            return rolled([F.get("hs", p + i) for i in range(k)])

        def passes(p: Column) -> Column:
            b = (gram_hash(p) % SIEVE_BITS).cast("int")
            return F.getbit(F.get(sieve, F.floor(b / 63).cast("int")), b % 63) == 1

        return F.transform(F.filter(places, passes), lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), gram_hash(p).alias("h"), F.concat_ws(" ", F.slice("w", p + 1, k)).alias("gram")))

    rows = hashed.select("id", "th", F.explode(F.concat(grams(PHRASE_K), grams(NOTICE_K))).alias("x")).select("id", "th", "x.*")
    hits = rows.join(known, (F.col("h") == F.col("th_")) & (F.col("gram") == F.col("tgram")) & (F.col("k") == F.col("tk")))
    # Rows with equal ids and texts find the same places: each counts once.
    same = ["id", "th", "template", "label", "phrase", "n_grams"]
    votes = hits.select(*same, "p", (F.col("p") - F.col("q")).alias("d")).distinct().groupBy(*same, "d").agg(F.count("*").alias("votes"))

    own = Window.partitionBy("id", "th", "template").orderBy("d")
    # A phrase stands at every diagonal with all its votes; a notice's neighbouring diagonals make one span.
    fresh = (F.col("phrase") | (F.col("d") - F.lag("d").over(own) > SLACK)).cast("int")
    runs = votes.withColumn("run", F.sum(F.coalesce(fresh, F.lit(1))).over(own))
    spans = runs.groupBy(*same, "run").agg(F.sum("votes").alias("votes"), F.min("d").alias("d"))
    spans = spans.withColumn("cover", F.least(F.lit(1.0), F.col("votes") / F.col("n_grams")))
    return split.select("id", "th", F.size("w").alias("n_words")), spans.where(F.when(F.col("phrase"), F.col("votes") == F.col("n_grams")).otherwise(F.col("cover") >= MIN_COVER))


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words, spans = scan(docs, key, text)

    def joined(c: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(c)))

    base = F.col("phrase")
    found = spans.groupBy("id", "th").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("d"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("d"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    found = found.withColumnsRenamed({"id": "fid", "th": "fth"})
    return words.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left").select(
        F.col("id").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = []
    for i, (label, text, k) in enumerate([*((v, p, PHRASE_K) for p, v in PHRASES.items()), *((v, t, NOTICE_K) for v, t in NOTICES.items())]):
        w = text.split()
        rows += [f"({i},'{label}',{k == PHRASE_K},{len(w) - k + 1},{k},'{' '.join(w[q : q + k])}',{q})" for q in range(len(w) - k + 1)]
    return f"""
WITH t(template, label, phrase, n_grams, k, gram, q) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
g AS (SELECT doc_id, p, x || ' ' || lead(x) OVER o AS g2, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g3 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
v AS (SELECT doc_id, template, label, phrase, n_grams, p - q AS d, count(*) AS votes FROM g JOIN t ON (k = {PHRASE_K} AND g2 = gram) OR (k = {NOTICE_K} AND g3 = gram) GROUP BY ALL),
f AS (SELECT *, CASE WHEN phrase OR lag(d) OVER o IS NULL OR d - lag(d) OVER o > {SLACK} THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY d)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY d) AS run FROM f),
s AS (SELECT doc_id, template, label, phrase, n_grams, run, sum(votes) AS votes, min(d) AS d FROM r GROUP BY ALL),
ok AS (SELECT *, least(1.0::DOUBLE, votes::DOUBLE / n_grams) AS cover FROM s WHERE CASE WHEN phrase THEN votes = n_grams ELSE votes::DOUBLE / n_grams >= {MIN_COVER} END),
a AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(d) FILTER (phrase) AS first_word, max(d) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (doc_id)"""


ORACLE_SQL = _oracle()
