"""L-1..L-8, Q-0..Q-9, J-1..J-3: label each source and classify every row.

Every labeller returns the same *classified* shape: the corpus columns plus
``reason`` (null = kept).  Reasons follow each source's own funnel order so
``groupBy(source, reason)`` reproduces the processing counts, and the
explicit ``unmapped`` / ``short`` / ``skip_flag`` / ``bad_label`` reasons make
the funnel sum to the input count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..functions.plan import fence
from ..session import written
from ..sources import adapters as A
from ..sources import mapping as M

CORPUS_COLUMNS = [
    "utterance", "source", "origin_id", "original_tag", "utterance_length", "word_count", *C.TRAIT_COLUMNS,
]
CLASSIFIED_COLUMNS = CORPUS_COLUMNS + ["label", "reason"]


def lookup(col: Column, table: dict) -> Column:
    """Small literal dictionary lookup as a CASE chain (null when absent)."""
    items = list(table.items())
    expr = F.when(col == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == F.lit(k), F.lit(v))
    return expr


def _finish(df: DataFrame, source: str, utterance: Column, origin: Column, tag: Column,
            traits: list[Column], pre_reason, label: Column) -> DataFrame:
    """Project a labelled source to the classified shape.

    Stage 1 fixes the row's fields; stage 2 computes the text features once
    (``with_text_features``); stage 3 derives the reason: the source's own
    pre-checks (``pre_reason(short)`` gets the stripped-length test) and
    then Q-1..Q-6.  Rows of ``X.meaningful_texts`` have passed Q-1..Q-6 and
    bring stage 2 with them."""
    base = df.select(
        utterance.alias("utterance"),
        F.lit(source).alias("source"),
        origin.alias("origin_id"),
        tag.alias("original_tag"),
        *[t.cast("double").alias(c) for t, c in zip(traits, C.TRAIT_COLUMNS)],
        label.cast("string").alias("label"),
        *[F.col(c) for c in _PRE_INPUTS if c in df.columns],
        *X.carried(df),
    )
    judged = "_slen" in df.columns
    staged = base if judged else X.with_text_features(base, "utterance")
    u = F.col("utterance")
    short = u.isNull() | (F.col("_slen") < C.PRE_FILTER_MIN_STRIPPED)
    reason = F.coalesce(pre_reason(short), F.when(u.isNull(), F.lit("short")),
                        *([] if judged else [X.staged_skip_reason()]))
    fenced = fence(staged.select(
        "utterance", "source", "origin_id", "original_tag",
        F.col("_len").cast("long").alias("utterance_length"),
        *C.TRAIT_COLUMNS, "label", reason.alias("reason"),
    ))
    # word_count sits above the fence: filters on ``reason`` run first and
    # queries that never read it prune the whole-text regex away.
    return fenced.select(
        "utterance", "source", "origin_id", "original_tag", "utterance_length",
        X.word_count(F.col("utterance")).cast("long").alias("word_count"),
        *C.TRAIT_COLUMNS, "label", "reason")


# Lookup columns the pre-checks read; carried through stage 1.
_PRE_INPUTS = ["_skip", "_mapped", "_is_speaker", "_n_emotions", "_bad_label", "_empty_label"]


def utterance_reasons(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``utterance_length``, ``word_count`` and ``reason`` (Q-1..Q-6;
    ``short`` for a missing text, ``meaningful`` for one that is kept)."""
    staged = X.with_text_features(df, text)
    t = F.col(text)
    reason = F.when(t.isNull(), F.lit("short")).otherwise(F.coalesce(X.staged_skip_reason(), F.lit("meaningful")))
    return fence(staged.select(*df.columns, F.col("_len").cast("long").alias("utterance_length"), reason.alias("reason"))) \
        .withColumn("word_count", X.word_count(t).cast("long"))


# ---------------------------------------------------------------- roles ---

def first_speakers(roles: DataFrame, emotions: DataFrame) -> DataFrame:
    """L-1 / W-1: the emotional speaker of each conversation is the speaker
    of its earliest row with a mapped emotion (before any length filter).

    ``min_by`` aggregates partially on the map side, so a conversation that
    holds a large share of all rows never lands whole in one task.
    """
    mapped = roles.join(emotions.select(F.col("emotion").alias("context")), "context", "left_semi")
    return mapped.groupBy("conv_id").agg(
        F.min_by("speaker_idx", "utterance_idx").alias("emotional_speaker"))


def label_roles(roles: DataFrame, emotions: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """L-2 with J-1 (mapping) and J-2 (roles): speakers get the emotion's
    traits, everyone else the listener constants; the skip flag applies to
    the speaker only.  Funnel: unmapped -> short -> skip flag -> Q-1..Q-6.
    Where ``roles`` are some of the rows, ``whole`` has all of them."""
    dim = emotions.withColumnRenamed("emotion", "context")
    rows = (roles.join(dim, "context", "left").join(first_speakers(roles if whole is None else whole, emotions), "conv_id", "left")
            .withColumn("_is_speaker", F.coalesce(F.col("speaker_idx") == F.col("emotional_speaker"),
                                                  F.lit(False)))
            .withColumn("_mapped", F.col("skip").isNotNull())
            .withColumn("_skip", F.coalesce(F.col("skip"), F.lit(False))))
    is_speaker = F.col("_is_speaker")
    listener = M.listener_traits()
    traits = [F.when(is_speaker, F.col(c)).otherwise(listener[i]) for i, c in enumerate(C.TRAIT_COLUMNS)]
    origin = F.concat(F.col("conv_id"), F.lit("_turn_"), F.col("utterance_idx").cast("string"))
    tag = F.concat(F.col("context"), F.when(is_speaker, F.lit("_speaker")).otherwise(F.lit("_listener")))

    def pre(short):
        return (F.when(~F.col("_mapped"), F.lit("unmapped")).when(short, F.lit("short"))
                .when(F.col("_is_speaker") & F.col("_skip"), F.lit("skip_flag")))
    return _finish(rows, "EmpatheticDialogues", F.col("utterance"), origin, tag, traits, pre, F.col("context"))


# ------------------------------------------------------------- dialogue ---

def label_dialogue(rows: DataFrame, numeric: DataFrame) -> DataFrame:
    """L-3: numeric emotion id per utterance (id past the array end = 0).
    Dialogues whose emotion list is empty are dropped (``no_emotions``).
    The dialogue source has no length pre-filter."""
    eid = F.coalesce(F.col("emotion_id"), F.lit(0)).cast("long")
    df = (rows.withColumn("emotion_id", eid).join(numeric, "emotion_id", "left")
          .withColumn("_n_emotions", F.col("n_emotions"))
          .withColumn("_mapped", F.col("emotion_name").isNotNull())
          .withColumn("_skip", F.coalesce(F.col("skip"), F.lit(False))))
    origin = F.concat(F.col("row_id").cast("string"), F.lit("_"), F.col("pos").cast("string"))
    traits = [F.col(c) for c in C.TRAIT_COLUMNS]
    label = F.when(F.col("n_emotions") > 0, F.col("emotion_id").cast("string"))

    def pre(short):
        return (F.when(F.col("_n_emotions") <= 0, F.lit("no_emotions"))
                .when(~F.col("_mapped"), F.lit("unmapped")).when(F.col("_skip"), F.lit("skip_flag")))
    return _finish(df, "DailyDialog", F.col("utterance"), origin, F.col("emotion_name"), traits, pre, label)


# --------------------------------------------------------- int labels ---

def label_int(src: DataFrame, emotions: DataFrame) -> DataFrame:
    """L-4 with P-8: label id -> name, love -> joy, then mapping lookup.
    Funnel: short -> bad label -> unmapped -> skip flag -> Q-1..Q-6."""
    name = lookup(F.col("label"), C.INT_LABELS)
    recoded = F.coalesce(lookup(name, C.INT_LABEL_RECODE), name)
    df = (src.withColumn("_bad_label", name.isNull()).withColumn("emotion", recoded)
          .join(emotions, "emotion", "left")
          .withColumn("_mapped", F.col("skip").isNotNull())
          .withColumn("_skip", F.coalesce(F.col("skip"), F.lit(False))))
    origin = F.concat(F.lit("row_"), F.col("row_idx").cast("string"))
    traits = [F.coalesce(F.col(c), F.lit(0.0)) for c in C.TRAIT_COLUMNS]

    def pre(short):
        return (F.when(short, F.lit("short")).when(F.col("_bad_label"), F.lit("bad_label"))
                .when(~F.col("_mapped"), F.lit("unmapped")).when(F.col("_skip"), F.lit("skip_flag")))
    return _finish(df, "EmotionLines", F.col("text"), origin, F.col("emotion"), traits, pre, F.col("emotion"))


# ------------------------------------------------------ string labels ---

def label_string(src: DataFrame, emotions: DataFrame) -> DataFrame:
    """L-5 with P-9: lower-cased label, mapping lookup.
    Funnel: short (or empty label) -> unmapped -> skip flag -> Q-1..Q-6."""
    df = (src.withColumn("emotion", F.lower(F.col("emotion"))).join(emotions, "emotion", "left")
          .withColumn("_empty_label", F.col("emotion").isNull() | (F.col("emotion") == ""))
          .withColumn("_mapped", F.col("skip").isNotNull())
          .withColumn("_skip", F.coalesce(F.col("skip"), F.lit(False))))
    e = F.col("emotion")
    traits = [F.coalesce(F.col(c), F.lit(0.0)) for c in C.TRAIT_COLUMNS]

    def pre(short):
        return (F.when(F.col("_empty_label") | short, F.lit("short"))
                .when(~F.col("_mapped"), F.lit("unmapped")).when(F.col("_skip"), F.lit("skip_flag")))
    return _finish(df, "MELD", F.col("text"), F.col("row_idx").cast("string"), e, traits, pre, e)


# --------------------------------------------------------- activations ---

def activation_traits() -> list[Column]:
    """L-6: sum of ``base * activation`` over activations > 0.1 in the fixed
    column order (so doubles reproduce exactly), then the three affect
    dimensions, clamped to [-1, 1]."""
    out = []
    for trait in C.TRAITS:
        acc = F.lit(0.0)
        for column, target in C.ACTIVATIONS:
            if target not in C.EMOTIONS:
                continue
            skip, scores = C.EMOTIONS[target]
            if skip or trait not in scores:
                continue
            a = F.col(column)
            active = (a > C.ACTIVATION_MIN) & ~F.isnan(a)
            acc = acc + F.when(active, F.lit(float(scores[trait])) * a).otherwise(F.lit(0.0))
        for dim, dim_trait in C.DIMENSIONS:
            if dim_trait == trait:
                d = F.col(dim)
                acc = acc + F.when(d > 0, (d - C.DIMENSION_CENTER) * C.DIMENSION_SCALE).otherwise(F.lit(0.0))
        out.append(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), acc)))
    return out


def label_activations(src: DataFrame) -> DataFrame:
    """L-6 + L-7: activation-weighted traits; an all-zero row whose dominant
    emotion is ``neutral`` takes the neutral mapping.  Raw traits are staged
    as columns first so the all-zero test does not repeat them."""
    raw_cols = [f"_raw_{c}" for c in C.TRAIT_COLUMNS]
    staged = src.select("*", *[t.alias(n) for t, n in zip(activation_traits(), raw_cols)])
    all_zero_raw = reduce(lambda a, b: a & b, [F.col(n) == 0 for n in raw_cols])
    neutral_skip, neutral_scores = C.EMOTIONS["neutral"]
    fallback = all_zero_raw & (F.col("major_emotion") == "neutral") & F.lit(not neutral_skip)
    staged = staged.withColumn("_fallback", fallback)
    neutral = C.sparse_to_dense(neutral_scores)
    traits = [F.when(F.col("_fallback"), F.lit(neutral[i])).otherwise(F.col(n)) for i, n in enumerate(raw_cols)]
    tag = F.coalesce(F.col("major_emotion"), F.lit("unknown"))

    def pre(short):
        return F.when(short, F.lit("short"))
    return _finish(staged, "IEMOCAP", F.col("transcription"), F.col("file"), tag, traits, pre,
                   F.col("major_emotion"))


# --------------------------------------------------------------- union ---

def _sources(spark: SparkSession, all_conv: DataFrame, conv: DataFrame, docs: DataFrame, emb: DataFrame) -> dict[str, DataFrame]:
    emotions = M.emotion_dim(spark)
    return {
        "EmpatheticDialogues": label_roles(A.roles_from_conversations(conv), emotions, A.roles_from_conversations(all_conv)),
        "DailyDialog": label_dialogue(A.dialogue_rows_from_conversations(conv, all_conv), M.numeric_dim(spark)),
        "EmotionLines": label_int(A.int_labels_from_documents(docs), emotions),
        "MELD": label_string(A.string_labels_from_documents(docs), emotions),
        "IEMOCAP": label_activations(A.activations_from_embeddings(emb, docs)),
    }


def classified_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five labelled sources, built from the test tables."""
    conv, docs, emb = (A.table(spark, sf_dir, t) for t in ("conversations", "documents", "embeddings"))
    return _sources(spark, conv, conv, docs, emb)


def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unsampled corpus, with Q-1..Q-6 first: they ask the text alone, so each
    text is judged once, whichever sources it is in, and the joins of the labels
    and what is written hold the texts that pass.  Speakers and dialogue
    lengths are those of all rows."""
    conv, docs, emb = (A.table(spark, sf_dir, t) for t in ("conversations", "documents", "embeddings"))
    some = written(X.meaningful_texts(conv.select("conv_id", "turn", "role", "text"), "text"), "meaningful-turns")
    texts = written(X.meaningful_texts(docs.select("doc_id", "text"), "text"), "meaningful-documents")
    parts = _sources(spark, conv, some, texts, emb).values()
    return kept(reduce(lambda a, b: a.unionByName(b), parts))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-8: every source row with its reason (null = kept)."""
    parts = list(classified_sources(spark, sf_dir).values())
    return reduce(lambda a, b: a.unionByName(b), parts)


def kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull()).select(*CORPUS_COLUMNS)


def corpus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unsampled corpus (schema of SURVEY 1.3)."""
    return kept(classified(spark, sf_dir))


def all_zero(prefix: str = "") -> Column:
    """Q-9: all ten traits are zero (flagged, never dropped)."""
    return reduce(lambda a, b: a & b, [F.col(prefix + c) == 0 for c in C.TRAIT_COLUMNS])
