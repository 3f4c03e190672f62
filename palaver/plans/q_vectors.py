"""Registered queries: vectors, voices, frames, intervals and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import vectors as V
from palaver.operators import intervals as N
from palaver.operators import lookups as L
from palaver.operators import sessions as S
from palaver.operators import voices as O
from palaver.plans.oracle import sql
from palaver.plans.registry import query

# The sample vectors are not clustered, hence the loose limits.
THRESHOLD, MARGIN = 0.25, 0.03


def r6(df):
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double"})


MATCH = f"""WITH s AS (SELECT vec_id, source_id, window_no, name, max(list_inner_product(v.embedding, p.embedding)) AS sim
  FROM v_vectors v, v_profiles p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) AS rn FROM s),
b AS (SELECT vec_id, source_id, window_no, max(name) FILTER (rn = 1) AS best_name, max(sim) FILTER (rn = 1) AS best, max(sim) FILTER (rn = 2) AS second FROM k WHERE rn <= 2 GROUP BY ALL),
d AS (SELECT *, CASE WHEN best < {THRESHOLD} THEN 'unknown_or_media' WHEN best - second < {MARGIN} THEN 'ambiguous_or_overlap' ELSE 'matched' END AS reason FROM b)
"""


def matched(t):
    return O.best_and_second(t.vectors, t.profiles)


@query(
    "best_and_second",
    sql("vectors profiles", MATCH + "SELECT vec_id, best_name, round(best, 6) AS best, round(second, 6) AS second, round(best - second, 6) AS margin FROM b"),
)
def best_and_second(t):
    m = matched(t)
    return r6(m.select("vec_id", "best_name", "best", "second", (F.col("best") - F.col("second")).alias("margin")))


# The same result by the way that serves voice sets too large to send out.
@query(
    "profile_match_sharded",
    sql("vectors profiles", MATCH + "SELECT vec_id, best_name, round(best, 6) AS best, round(second, 6) AS second FROM b"),
)
def profile_match_sharded(t):
    m = O.best_and_second(t.vectors, t.profiles, broadcast_elements=0)
    return r6(m.select("vec_id", "best_name", "best", "second"))


@query(
    "profile_match_cross",
    sql("vectors profiles", MATCH + "SELECT vec_id, source_id, window_no, best_name, round(best, 6) AS best FROM b"),
)
def profile_match_cross(t):
    return r6(matched(t).select("vec_id", "source_id", "window_no", "best_name", "best"))


@query(
    "identify_margin",
    sql("vectors profiles", MATCH + "SELECT vec_id, reason, CASE WHEN reason = 'matched' THEN best_name ELSE '' END AS speaker FROM d"),
)
def identify_margin(t):
    d = O.decide(matched(t), THRESHOLD, MARGIN)
    return d.select("vec_id", "reason", F.coalesce("speaker", F.lit("")).alias("speaker"))


@query(
    "window_reasons",
    sql("vectors profiles", MATCH + "SELECT source_id, reason, count(*) AS n, count(*) / 10.0::DOUBLE AS share FROM d GROUP BY source_id, reason"),
)
def window_reasons(t):
    d = O.decide(matched(t), THRESHOLD, MARGIN)
    m = O.reason_maps(d)
    return m.select("source_id", F.explode("window_reasons").alias("reason", "n")).withColumn(
        "share", F.col("n") / 10.0
    )


IDENT = f"""WITH c AS (SELECT vec_id, name, max(list_inner_product(v.embedding, p.embedding) / ((sqrt(list_inner_product(v.embedding, v.embedding)) + 1e-8) * (sqrt(list_inner_product(p.embedding, p.embedding)) + 1e-8))) AS sim
  FROM v_vectors v, v_profiles p GROUP BY ALL),
b AS (SELECT vec_id, max(sim) AS sim, min_by(name, (-sim, name)) AS name FROM c GROUP BY vec_id)
"""
CONF = "CASE WHEN sim >= 1.0 THEN 1.0 WHEN sim <= {t} THEN 0.0 ELSE 0.5 + (sim - {t}) / (2.0 * (1.0 - {t})) END"


@query(
    "identify_topk1",
    sql("vectors profiles", IDENT + f"SELECT vec_id, CASE WHEN sim >= {THRESHOLD} THEN name ELSE 'unknown' END AS speaker, round({CONF.format(t=THRESHOLD)}, 6)::DOUBLE AS confidence FROM b"),
)
def identify_topk1(t):
    # Scaling each vector by its padded norm makes the inner product the padded cosine.
    def unit(df):
        n = V.norm(F.col("embedding")) + 1e-8
        return df.withColumn("_n", n).withColumn(
            "embedding", F.transform("embedding", lambda v: v / F.col("_n"))
        ).drop("_n")

    m = O.best_and_second(unit(t.vectors), unit(t.profiles))
    return m.select(
        "vec_id",
        F.when(F.col("best") >= THRESHOLD, F.col("best_name")).otherwise("unknown").alias("speaker"),
        F.round(V.similarity_to_confidence(F.col("best"), THRESHOLD), 6).alias("confidence"),
    )


@query(
    "similarity_to_confidence",
    sql("vectors profiles", MATCH + f"SELECT vec_id, round({CONF.replace('sim', 'best').format(t=THRESHOLD)}, 6)::DOUBLE AS confidence FROM b"),
)
def similarity_to_confidence(t):
    c = V.similarity_to_confidence(F.col("best"), THRESHOLD)
    return matched(t).select("vec_id", F.round(c, 6).alias("confidence"))


@query(
    "cosine",
    sql("", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ((sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8)), 6) AS cosine, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
)
def cosine(t):
    e = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return r6(e.join(n, "vec_id").select("vec_id", V.cosine(a, b).alias("cosine"), V.dot(a, b).alias("dot")))


WIN = "w AS (SELECT vec_id, source_id, window_no * 16000 AS w_start, window_no * 16000 + 32000 AS w_end, CASE WHEN reason = 'matched' THEN best_name END AS speaker, best AS similarity FROM d)"


def vote_windows(t):
    d = O.decide(matched(t), 0.20, 0.0)
    return d.select(
        "source_id",
        (F.col("window_no") * 16_000).alias("w_start"),
        (F.col("window_no") * 16_000 + 32_000).alias("w_end"),
        "speaker",
        F.col("best").alias("similarity"),
        F.lit(176_000).cast("bigint").alias("n_samples"),
    )


# Looser limits here, so that neighbouring windows of the sample agree now and then.
VOTE = MATCH.replace(f"best < {THRESHOLD}", "best < 0.2").replace(f"best - second < {MARGIN}", "best - second < 0.0")


@query(
    "span_voting",
    sql("vectors profiles", VOTE + f""", {WIN},
    v AS (SELECT source_id, c AS core, bool_and(speaker IS NOT NULL) AS all_in, count(DISTINCT speaker) AS n, min(speaker) AS speaker, min(similarity) AS similarity
      FROM w, range(0, 11) r(c) WHERE w_start < (c + 1) * 16000 AND w_end > c * 16000 GROUP BY ALL),
    a AS (SELECT *, core - row_number() OVER (PARTITION BY source_id, speaker ORDER BY core) AS island FROM v WHERE all_in AND n = 1)
    SELECT source_id, speaker, min(core) * 16000 AS start_sample, (max(core) + 1) * 16000 AS end_sample, round(min(similarity), 6) AS similarity
    FROM a GROUP BY source_id, speaker, island HAVING (max(core) + 1 - min(core)) * 16000 >= 16000"""),
)
def span_voting(t):
    return r6(O.span_voting(vote_windows(t), min_samples=16_000))


@query(
    "window_core_overlap",
    sql("vectors profiles", VOTE + f""", {WIN} SELECT source_id, w_start, c * 16000 AS c_start FROM w, range(0, 11) r(c) WHERE w_start < (c + 1) * 16000 AND w_end > c * 16000"""),
)
def window_core_overlap(t):
    w = vote_windows(t).select("source_id", "w_start", "w_end")
    cores = (
        t.vectors.select("source_id")
        .distinct()
        .select("source_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("c"))
        .select("source_id", (F.col("c") * 16_000).alias("c_start"), ((F.col("c") + 1) * 16_000).alias("c_end"))
    )
    out = N.range_join(w, cores, ["source_id"], ("w_start", "w_end"), ("c_start", "c_end"), 32_000)
    return out.select("source_id", "w_start", F.col("c_start").cast("bigint").alias("c_start"))


@query(
    "sliding_windows",
    sql("segments", """WITH n AS (SELECT segment_id, (end_us - start_us) // 1000 AS n_samples FROM v_segments),
    s AS (SELECT segment_id, n_samples, unnest(range(0, n_samples - 2000 + 1, 1000)) AS w_start FROM n WHERE n_samples >= 2000
      UNION ALL SELECT segment_id, n_samples, n_samples - 2000 FROM n WHERE n_samples >= 2000 AND (n_samples - 2000) % 1000 <> 0)
    SELECT segment_id, count(*) AS windows, CAST(sum(w_start) AS BIGINT) AS start_sum, max(w_start) AS last_start FROM s GROUP BY segment_id"""),
)
def sliding_windows(t):
    n = t.segments.select("segment_id", F.expr("(end_us - start_us) div 1000").alias("n_samples"))
    w = O.sliding_windows(n, window=2000, hop=1000)
    return w.groupBy("segment_id").agg(
        F.count("*").alias("windows"), F.sum("w_start").alias("start_sum"), F.max("w_start").alias("last_start")
    )


@query(
    "vector_mean",
    sql("", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
    SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, round(m / n, 6) AS v FROM m JOIN n USING (label)"""),
)
def vector_mean(t):
    e = t.raw("embeddings").select(
        F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    m = O.vector_mean(e, "label")
    return m.select("label", F.posexplode("mean").alias("pos", "v")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v")
    )


@query(
    "enrollment_quality",
    sql("vectors", """WITH e AS (SELECT source_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM v_vectors),
    m AS (SELECT source_id, pos, avg(v) AS m FROM e GROUP BY ALL),
    c AS (SELECT source_id, list(m / n ORDER BY pos) AS centre FROM m JOIN (SELECT source_id, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) USING (source_id) GROUP BY source_id),
    q AS (SELECT source_id, count(*) AS window_count, count(DISTINCT window_no // 4) AS prototype_count,
      avg(len(list_filter(embedding, lambda x: abs(x) >= 0.3)) / 64.0) AS clipping_fraction,
      quantile_cont(list_inner_product(embedding, centre), 0.5) AS self_consistency FROM v_vectors JOIN c USING (source_id) GROUP BY source_id)
    SELECT source_id, window_count, prototype_count, round(clipping_fraction, 6)::DOUBLE AS clipping_fraction, round(self_consistency, 6) AS self_consistency,
      window_count * 2.0::DOUBLE AS voiced_seconds,
      CASE WHEN clipping_fraction > 0.03 THEN 'clipping' WHEN window_count * 2.0 < 10 OR window_count < 5 OR prototype_count < 2 THEN 'not_enough_speech'
        WHEN self_consistency < 0.70 THEN 'inconsistent' ELSE 'accepted' END AS verdict FROM q"""),
)
def enrollment_quality(t):
    blocks = t.vectors.select(
        "source_id",
        F.expr("window_no div 4").alias("block"),
        (F.size(F.filter("embedding", lambda x: F.abs(x) >= 0.3)) / 64.0).alias("clipped"),
        "embedding",
    )
    return r6(O.enrollment_quality(blocks, "source_id"))


@query(
    "rms_db",
    sql("vectors", "SELECT vec_id, round(20 * log10(sqrt(list_inner_product(embedding, embedding) / 64)), 6) AS db FROM v_vectors"),
)
def rms_db(t):
    return t.vectors.select("vec_id", F.round(V.rms_db(F.col("embedding")), 6).alias("db"))


# Every vector is unit length, so the sample level is the same for all; scaling by vec_id spreads it.
SCALED = "[x * (vec_id % 97) / 97.0 FOR x IN embedding]"


def scaled(t):
    f = F.col("vec_id") % 97
    return t.vectors.select("vec_id", F.transform("embedding", lambda x: x * f / 97.0).alias("a"))


@query(
    "rms_gate",
    sql("vectors", f"WITH s AS (SELECT vec_id, {SCALED} AS a FROM v_vectors), d AS (SELECT vec_id, sqrt(list_inner_product(a, a) / 64) AS rms FROM s) SELECT vec_id FROM d WHERE rms >= 1e-10 AND 20 * log10(greatest(rms, 1e-10)) >= -30"),
)
def rms_gate(t):
    return scaled(t).filter(V.rms_db(F.col("a")) >= -30.0).select("vec_id")


@query(
    "normalize_gain",
    sql("vectors", f"""WITH s AS (SELECT vec_id, {SCALED} AS a FROM v_vectors), d AS (SELECT *, sqrt(list_inner_product(a, a) / 64) AS rms FROM s),
    g AS (SELECT *, CASE WHEN rms < 1e-10 THEN -100 ELSE 20 * log10(greatest(rms, 1e-10)) END AS db FROM d),
    n AS (SELECT vec_id, db, a, [x * pow(10, (-6.0 - db) / 20) FOR x IN a] AS b FROM g),
    p AS (SELECT *, list_max([abs(x) FOR x IN b]) AS m FROM n)
    SELECT vec_id, round(CASE WHEN db < -60 THEN a[1] WHEN m > 0.99 THEN b[1] / m * 0.99 ELSE b[1] END, 6) AS first,
      round(CASE WHEN db < -60 THEN list_max([abs(x) FOR x IN a]) WHEN m > 0.99 THEN 0.99 ELSE m END, 6)::DOUBLE AS peak FROM p"""),
)
def normalize_gain(t):
    n = scaled(t).select("vec_id", V.normalize_gain(F.col("a"), -6.0).alias("b"))
    return r6(n.select("vec_id", F.col("b")[0].alias("first"), V.peak(F.col("b")).alias("peak")))


@query(
    "level_quality",
    sql("vectors", f"""WITH s AS (SELECT vec_id, list_max([abs(x) FOR x IN {SCALED}]) AS m FROM v_vectors)
    SELECT vec_id, round(m, 6) AS amplitude, CASE WHEN m < 0.05 THEN 'too_low' WHEN m < 0.3 THEN 'acceptable' WHEN m < 0.8 THEN 'good' ELSE 'clipping' END AS level FROM s"""),
)
def level_quality(t):
    p = scaled(t).select("vec_id", V.peak(F.col("a")).alias("amplitude"))
    return r6(p.withColumn("level", V.level_quality(F.col("amplitude"))))


@query(
    "noise_profile",
    sql("vectors", f"""WITH s AS (SELECT vec_id, {SCALED} AS a FROM v_vectors), d AS (SELECT vec_id, a, sqrt(list_inner_product(a, a) / 64) AS rms FROM s)
    SELECT vec_id, round(rms, 6) AS rms, round(list_max([abs(x) FOR x IN a]), 6) AS max_amplitude, round(least(greatest(rms * 5, 0.3), 0.7), 6)::DOUBLE AS threshold,
    round(CASE WHEN rms < 1e-10 THEN -100 ELSE 20 * log10(greatest(rms, 1e-10)) END, 6)::DOUBLE AS floor_db FROM d"""),
)
def noise_profile(t):
    return r6(scaled(t).select("vec_id", *[c.alias(n) for n, c in V.noise_profile(F.col("a")).items()]))


@query(
    "lag_correlation",
    sql("vectors", """WITH p AS (SELECT source_id, embedding AS b, lag(embedding) OVER (PARTITION BY source_id ORDER BY window_no) AS a FROM v_vectors),
    s AS (SELECT source_id, list_inner_product(a, b) - list_sum(a) * list_sum(b) / 64 AS cov, list_inner_product(a, a) - list_sum(a) * list_sum(a) / 64 AS va,
      list_inner_product(b, b) - list_sum(b) * list_sum(b) / 64 AS vb FROM p WHERE a IS NOT NULL)
    SELECT source_id, round(avg(cov / sqrt(va * vb)), 6) AS mean_r, avg(cov / sqrt(va * vb)) > 0.02 AS repetitive FROM s GROUP BY source_id"""),
)
def lag_correlation(t):
    return r6(O.lag_correlation(t.vectors, "source_id", "window_no", at=0.02))


GAUSS = """p AS (SELECT name, avg(embedding[1]) + 1 AS pm, 0.2 AS ps, avg(embedding[2]) + 1 AS cm, 0.3 AS cs FROM v_profiles GROUP BY name),
f AS (SELECT vec_id, embedding[1] + 1 AS pitch, embedding[2] + 1 AS centroid, abs(embedding[3]) * 5 AS voiced FROM v_vectors),
z AS (SELECT vec_id, voiced, name, abs(pitch - pm) / ps AS zp, greatest(0.0, 1.0 - (0.7 * abs(pitch - pm) / ps + 0.3 * abs(centroid - cm) / cs) / 4.0) AS s FROM f, p),
b AS (SELECT vec_id, any_value(voiced) AS voiced, max(s) AS s, max_by(name, (s, zp <= 2.0, name)) AS name, max_by(zp <= 2.0, (s, zp <= 2.0, name)) AS near FROM z GROUP BY vec_id)"""


@query(
    "zscore_match",
    sql("vectors profiles", f"WITH {GAUSS} SELECT vec_id, CASE WHEN voiced >= 0.1 AND s >= 0.5 AND near THEN name ELSE 'unknown' END AS speaker, round(CASE WHEN voiced < 0.1 THEN 0.0 WHEN s >= 0.5 AND near THEN s ELSE 1.0 - s END, 6)::DOUBLE AS confidence FROM b"),
)
def zscore_match(t):
    p = t.profiles.groupBy("name").agg(
        (F.avg(F.col("embedding")[0]) + 1).alias("pitch_mean"),
        F.lit(0.2).alias("pitch_std"),
        (F.avg(F.col("embedding")[1]) + 1).alias("centroid_mean"),
        F.lit(0.3).alias("centroid_std"),
        F.lit(2.0).alias("multiplier"),
    )
    f = t.vectors.select(
        "vec_id",
        (F.col("embedding")[0] + 1).alias("pitch"),
        (F.col("embedding")[1] + 1).alias("centroid"),
        (F.abs(F.col("embedding")[2]) * 5).alias("voiced_ratio"),
    )
    return r6(O.zscore_match(f, p, "vec_id"))


# Frames: every element of a vector is one frame of a clip.
FRAMES = "fr AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS frame, unnest(embedding) AS x FROM v_vectors), fd AS (SELECT *, 20 * log10(abs(x) + 1e-9) AS db FROM fr)"


def frames(t):
    f = t.vectors.select("vec_id", F.posexplode("embedding").alias("frame", "x"))
    return f.select(
        "vec_id",
        F.col("frame").cast("bigint").alias("frame"),
        "x",
        (F.lit(20.0) * F.log10(F.abs("x") + 1e-9)).alias("db"),
    )


@query(
    "frame_snr",
    sql("vectors", f"""WITH {FRAMES}, q AS (SELECT vec_id, count(*) AS n, quantile_cont(db, 0.1) AS noise, quantile_cont(db, 0.7) AS p70 FROM fd GROUP BY vec_id),
    s AS (SELECT vec_id, quantile_cont(db, 0.5) AS sig FROM fd JOIN q USING (vec_id) WHERE db >= p70 GROUP BY vec_id)
    SELECT vec_id, n, round(greatest(0.0, sig - noise), 6)::DOUBLE AS snr FROM q JOIN s USING (vec_id)"""),
)
def frame_snr(t):
    return r6(N.frame_snr(frames(t), "vec_id"))


@query(
    "silence_boundaries",
    sql("vectors", f"""WITH {FRAMES}, i AS (SELECT vec_id, frame, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g FROM fd WHERE db < -25)
    SELECT vec_id, (min(frame) + max(frame)) // 2 * 400 AS boundary FROM i GROUP BY vec_id, g"""),
)
def silence_boundaries(t):
    return N.silence_boundaries(frames(t), "vec_id", below=-25.0, hop=400)


@query(
    "lowest_energy_cut",
    sql("vectors", f"WITH {FRAMES} SELECT vec_id, CAST(min_by(frame, (x * x, frame)) AS BIGINT) AS cut FROM fd WHERE frame BETWEEN 14 AND 51 GROUP BY vec_id"),
)
def lowest_energy_cut(t):
    f = frames(t).filter("frame BETWEEN 14 AND 51").withColumn("energy", F.col("x") * F.col("x"))
    return N.lowest_energy_cut(f, "vec_id")


@query(
    "gap_fill",
    sql("vectors", """WITH f AS (SELECT vec_id // 50 AS clip, vec_id % 50 * 3 // 2 AS slot, vec_id AS start_us, embedding[1] AS v FROM v_vectors WHERE vec_id % 7 <> 0),
    g AS (SELECT clip, unnest(range(min(slot), max(slot) + 1)) AS slot FROM f GROUP BY clip),
    l AS (SELECT clip, slot, max_by(v, start_us) AS v FROM f GROUP BY ALL)
    SELECT clip, slot, round(coalesce(v, 0.0), 6) AS value FROM g LEFT JOIN l USING (clip, slot)"""),
)
def gap_fill(t):
    f = t.vectors.filter("vec_id % 7 <> 0").select(
        F.expr("vec_id div 50").alias("clip"),
        F.expr("vec_id % 50 * 3 div 2").alias("slot"),
        F.col("vec_id").alias("start_us"),
        F.col("embedding")[0].alias("value"),
    )
    return r6(N.gap_fill(f, "clip"))


CLIPS = "c AS (SELECT segment_id, (end_us - start_us) / 1e6 AS d FROM v_segments)"


def clips(t):
    return t.segments.select("segment_id", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"))


@query(
    "chunk_at_silence",
    sql("segments", f"""WITH {CLIPS}, k AS (SELECT segment_id, d, unnest(range(0, greatest(CAST(ceil(d / 15.0) AS BIGINT), 1))) AS chunk_no FROM c)
    SELECT segment_id, chunk_no, round(chunk_no * 15.0, 6)::DOUBLE AS start, round(least((chunk_no + 1) * 15.0, d), 6)::DOUBLE AS "end" FROM k"""),
)
def chunk_at_silence(t):
    return r6(N.chunk_at_silence(clips(t), None, "segment_id"))


SNAP = f"""WITH {CLIPS}, n AS (SELECT segment_id, d, greatest(floor(d / 4.0), 1)::BIGINT AS k FROM c),
w AS (SELECT segment_id, d, k, 0::BIGINT AS chunk_no, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e FROM n
  UNION ALL
  SELECT segment_id, d, k, chunk_no + 1, e, CASE WHEN goal < d AND len(near) > 0 THEN list_sort([{{'g': abs(b - goal), 'b': b}} FOR b IN near])[1].b ELSE goal END
  FROM (SELECT *, [i * 4.0::DOUBLE FOR i IN range(1, k + 1) IF i * 4.0 >= e + 3 AND i * 4.0 <= least(e + 30, d)] AS near FROM (
    SELECT *, least(e + 15.0, d) AS goal FROM w WHERE e < d)))
SELECT segment_id, chunk_no - 1 AS chunk_no, round(s, 6) AS start, round(e, 6) AS "end" FROM w WHERE chunk_no > 0"""


@query("chunk_at_silence_snapped", sql("segments", SNAP, recursive=True))
def chunk_at_silence_snapped(t):
    c = clips(t)
    every = F.sequence(F.lit(1), F.greatest(F.floor(F.col("duration") / 4.0), F.lit(1)).cast("int"))
    b = c.select("segment_id", F.explode(every).alias("i")).select("segment_id", (F.col("i") * 4.0).alias("boundary"))
    return r6(N.chunk_at_silence(c, b, "segment_id", snap=True))


@query(
    "nearest_boundary",
    sql("segments", f"""WITH {CLIPS}, b AS (SELECT segment_id, d, unnest(range(1, CAST(floor(d / 4.0) AS BIGINT) + 1)) * 4.0 AS b FROM c)
    SELECT segment_id, round(min_by(b, (abs(b - d / 2), b)), 6)::DOUBLE AS boundary FROM b GROUP BY segment_id"""),
)
def nearest_boundary(t):
    n = F.floor(F.col("duration") / 4.0).cast("int")
    c = clips(t).filter(n >= 1)
    b = c.select("segment_id", "duration", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    b = b.withColumn("b", F.col("i") * 4.0)
    dist = F.abs(F.col("b") - F.col("duration") / 2)
    return r6(b.groupBy("segment_id").agg(F.min_by("b", F.struct(dist, F.col("b"))).alias("boundary")))


@query(
    "chunk_draft_overlap",
    sql("turns", """WITH k AS (SELECT conv_id, start_us + i * 15000000 AS c_start, start_us + (i + 1) * 15000000 AS c_end FROM
      (SELECT conv_id, min(start_us) AS start_us, unnest(range(0, (max(end_us) - min(start_us)) // 15000000 + 1)) AS i FROM v_turns GROUP BY conv_id))
    SELECT k.conv_id, c_start, string_agg(segment_id, ' ' ORDER BY start_us, segment_id) AS drafts FROM k JOIN v_turns v ON v.conv_id = k.conv_id AND v.end_us > c_start AND v.start_us < c_end GROUP BY ALL"""),
)
def chunk_draft_overlap(t):
    from palaver.operators.transcripts import joined, ordered_parts

    k = t.turns.groupBy("conv_id").agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    k = k.select("conv_id", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(e - s) div 15000000"))).alias("i"))
    k = k.select(
        "conv_id",
        (F.col("s") + F.col("i") * 15_000_000).alias("c_start"),
        (F.col("s") + (F.col("i") + 1) * 15_000_000).alias("c_end"),
    )
    drafts = t.turns.select("conv_id", "start_us", "end_us", "segment_id")
    j = N.range_join(k, drafts, ["conv_id"], ("c_start", "c_end"), ("start_us", "end_us"), 15_000_000)
    parts = ordered_parts(j, ["conv_id", "c_start"], ["start_us", "segment_id"], w=F.col("segment_id"))
    return parts.select("conv_id", "c_start", joined("w", " ").alias("drafts"))


@query(
    "word_in_core",
    sql("turns", """WITH w AS (SELECT segment_id, words, unnest(range(0, words)) AS i, unnest(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '')) AS w FROM v_turns)
    SELECT segment_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (i * 0.4 + 0.2 >= 2.0 AND i * 0.4 + 0.2 < 6.0), '') AS text, '' AS status FROM w GROUP BY segment_id""".replace("\\\\", "\\")),
)
def word_in_core(t):
    from palaver.functions.text import words

    structs = F.transform(
        words(F.col("text")),
        lambda w, i: F.struct(w.alias("word"), (i * 0.4).alias("start"), (i * 0.4 + 0.4).alias("end")),
    )
    rows = t.turns.select("segment_id", structs.alias("ws"))
    own = N.words_in_core(rows, F.col("ws"), F.lit(32_000), F.lit(96_000), 16_000)
    return rows.select("segment_id", *[c.alias(n) for n, c in own.items()])


@query(
    "timeline_layout",
    sql("segments", """WITH o AS (SELECT device_id, date, segment_id, start_us, end_us, start_us - min(start_us) OVER (PARTITION BY device_id, date) AS rel FROM v_segments),
    s AS (SELECT *, CAST(round(rel * 16000.0::DOUBLE / 1e6) AS BIGINT) AS off, CAST(round(rel * 16000.0::DOUBLE / 1e6) AS BIGINT) + CAST(round((end_us - start_us) * 16000.0::DOUBLE / 1e6) AS BIGINT) AS fin FROM o),
    p AS (SELECT *, coalesce(max(fin) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur, lag(end_us) OVER w AS pe, lead(start_us) OVER w AS ns
      FROM s WINDOW w AS (PARTITION BY device_id, date ORDER BY start_us, segment_id))
    SELECT segment_id, off AS offset_samples, greatest(off - cur, 0) AS silence, greatest(cur - off, 0) AS skip,
      pe IS NULL OR start_us - pe > 25000 AS fade_in, ns IS NULL OR ns - end_us > 25000 AS fade_out FROM p"""),
)
def timeline_layout(t):
    rows = t.segments.select("device_id", "date", "segment_id", "start_us", "end_us")
    out = N.timeline_layout(rows, ["device_id", "date"], "segment_id")
    return out.select(
        "segment_id", F.col("offset").alias("offset_samples"), "silence", "skip", "fade_in", "fade_out"
    )


@query(
    "split_long_interval",
    sql("segments", """WITH k AS (SELECT segment_id, start_us, end_us, unnest(range(0, greatest(CAST(ceil((end_us - start_us) / 20000000) AS BIGINT), 1))) AS piece_no FROM v_segments)
    SELECT segment_id, piece_no, start_us + piece_no * 20000000 AS piece_start_us, least(start_us + (piece_no + 1) * 20000000, end_us) AS piece_end_us FROM k"""),
)
def split_long_interval(t):
    out = S.split_interval(t.segments.select("segment_id", "start_us", "end_us"), 20.0)
    return out.select("segment_id", "piece_no", "piece_start_us", "piece_end_us")


BOUND = "(start_us // 3600000000 * 3600000000)"


@query(
    "pad_clip",
    sql("segments", f"SELECT segment_id, greatest(start_us - 300000, {BOUND}) AS start_us, least(end_us + 300000, {BOUND} + 3600000000) AS end_us FROM v_segments"),
)
def pad_clip(t):
    low = F.expr("start_us div 3600000000 * 3600000000")
    rows = t.segments.select("segment_id", "start_us", "end_us").withColumn("low", low)
    out = N.pad_clip(rows, 0.3, F.col("low"), F.col("low") + 3_600_000_000)
    return out.select("segment_id", "start_us", "end_us")


@query(
    "min_duration",
    sql("segments", "SELECT segment_id FROM v_segments WHERE end_us + 300000 - (start_us - 300000) >= 5000000"),
)
def min_duration(t):
    rows = t.segments.select("segment_id", "start_us", "end_us")
    free = N.pad_clip(rows, 0.3, F.lit(-(2**62)), F.lit(2**62))
    return N.min_duration(free, 5.0).select("segment_id")


@query(
    "continuity_groups",
    sql("segments", """WITH c AS (SELECT segment_id, piece, s, e, lag(e) OVER w AS pe FROM
      (SELECT segment_id, i AS piece, start_us + i * 1000000 + CASE WHEN i >= 3 THEN 20000 ELSE 0 END + CASE WHEN i >= 5 THEN 40000 ELSE 0 END AS s,
        start_us + (i + 1) * 1000000 + CASE WHEN i >= 3 THEN 20000 ELSE 0 END + CASE WHEN i >= 5 THEN 40000 ELSE 0 END AS e
       FROM v_segments, range(0, 8) r(i)) WINDOW w AS (PARTITION BY segment_id ORDER BY s, piece)),
    g AS (SELECT *, sum(CASE WHEN pe IS NULL OR abs(s - pe) > 25000 THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY s, piece) AS grp FROM c)
    SELECT segment_id, min(piece) AS first_piece, count(*) AS n FROM g GROUP BY segment_id, grp"""),
)
def continuity_groups(t):
    base = t.segments.select("segment_id", "start_us", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("piece"))
    shift = F.when(F.col("piece") >= 3, 20_000).otherwise(0) + F.when(F.col("piece") >= 5, 40_000).otherwise(0)
    s = F.col("start_us") + F.col("piece").cast("bigint") * 1_000_000 + shift
    rows = base.select("segment_id", F.col("piece").cast("bigint").alias("piece"), s.alias("start_us"), (s + 1_000_000).alias("end_us"))
    g = S.continuity_groups(rows, ["segment_id"], "piece")
    return g.groupBy("segment_id", "session_first").agg(F.count("*").alias("n")).select(
        "segment_id", F.col("session_first").alias("first_piece"), "n"
    )


LIMITS = {"p_size": (1, 40), "p_retailprice": (900.0, 1500.0)}


@query(
    "eq_range_check",
    sql("", "SELECT p_partkey, concat_ws(',', CASE WHEN NOT coalesce(p_size BETWEEN 1 AND 40, false) THEN 'p_size' END, CASE WHEN NOT coalesce(p_retailprice BETWEEN 900 AND 1500, false) THEN 'p_retailprice' END) AS violations FROM part"),
)
def eq_range_check(t):
    bad = L.in_range({k: k for k in LIMITS}, LIMITS)
    return t.raw("part").select("p_partkey", F.array_join(bad, ",").alias("violations"))


@query(
    "public_profiles",
    sql("profiles", "SELECT profile_id, name, model, enabled, 64 AS dimensions FROM v_profiles"),
)
def public_profiles(t):
    quality = F.from_json(F.to_json(F.struct(F.size("embedding").alias("dimensions"))), "dimensions int")
    return t.profiles.select("profile_id", "name", "model", "enabled", quality["dimensions"].alias("dimensions"))


@query(
    "gate_counts",
    sql("vectors profiles", MATCH + "SELECT (SELECT count(*) FROM v_profiles WHERE enabled) AS enabled_profiles, (SELECT count(DISTINCT source_id) FROM d) - (SELECT count(DISTINCT source_id) FROM d WHERE reason = 'matched') AS excluded_sources, (SELECT max(source_id) FROM d) AS last_source"),
)
def gate_counts(t):
    d = O.decide(matched(t), THRESHOLD, MARGIN)
    per = d.groupBy("source_id").agg(F.bool_or(F.col("reason") == "matched").alias("ok"))
    a = t.profiles.filter("enabled").agg(F.count("*").alias("enabled_profiles"))
    b = per.agg(F.count_if(~F.col("ok")).alias("excluded_sources"), F.max("source_id").alias("last_source"))
    return a.join(F.broadcast(b))  # two rows of one
