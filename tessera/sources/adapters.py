"""S-2..S-6, S-11: the five labelled source shapes.

Real deployments point these readers at the dialogue datasets; the
``from_*`` builders derive the same shapes from the driver's test tables
(rules in FIXTURES.md section 2) so every operator runs on data that grows
with the scale factor.  No builder collects a group: the dialogue-array
source is produced directly in its exploded (one row per utterance) form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import carried
from .mapping import alphabetical_emotion

EMOTION_SLOTS = len(C.ALPHABETICAL_EMOTIONS) + 2   # 41 names + 2 unmapped
ARRAY_EMOTION_IDS = 8                              # ids 0..6 mapped, 7 unmapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  Its partitions are the scan's splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_source(spark: SparkSession, reader, schema) -> DataFrame:
    """S-4..S-6 tolerance: a source that fails to load contributes nothing."""
    try:
        return reader()
    except Exception as exc:  # noqa: BLE001 - any load failure is tolerated
        print(f"Warning: could not load source: {exc}")
        return spark.createDataFrame([], schema)


def select_split(df: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """S-11: keep one split when the source carries a split column."""
    if split is None or column not in df.columns:
        return df
    return df.filter(F.col(column) == split)


# ------------------------------------------------------------ builders ---

def roles_from_conversations(conversations: DataFrame) -> DataFrame:
    """S-2 shape: conv_id, utterance_idx, speaker_idx, context, utterance."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("utterance_idx"),
        F.col("role").alias("speaker_idx"),
        alphabetical_emotion(F.pmod(F.col("conv_id"), F.lit(EMOTION_SLOTS))).alias("context"),
        F.col("text").alias("utterance"),
        *carried(conversations),
    )


def dialogue_rows_from_conversations(conversations: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """S-3 in exploded form: row_id, pos, utterance, emotion_id.

    Each conversation is one dialogue; utterances are ordered by ``turn``
    (0-based, contiguous) and emotion ``pos`` is ``(conv_id + turn) % 8``.
    Every fifth dialogue has one emotion fewer than utterances, so its last
    utterance gets no id (null -> default 0 when labelled).  Dialogues whose
    emotion list is empty carry ``n_emotions = 0`` and are dropped by the
    labeller.  The utterance count comes from a partially aggregated
    ``groupBy`` joined back, never from collecting a dialogue.  Where
    ``conversations`` are some of the rows, ``whole`` has all of them.
    """
    sizes = (conversations if whole is None else whole).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_utterances"))
    n_emotions = F.col("n_utterances") - F.when(F.pmod(F.col("conv_id"), F.lit(5)) == 0, 1).otherwise(0)
    return (
        conversations.join(sizes, "conv_id")
        .select(
            F.col("conv_id").alias("row_id"),
            F.col("turn").cast("long").alias("pos"),
            F.col("text").alias("utterance"),
            n_emotions.alias("n_emotions"),
            F.when(F.col("turn") < n_emotions,
                   F.pmod(F.col("conv_id") + F.col("turn"), F.lit(ARRAY_EMOTION_IDS))).alias("emotion_id"),
            *carried(conversations),
        )
    )


def int_labels_from_documents(documents: DataFrame) -> DataFrame:
    """S-4 shape: label (0-5, 6 = bad), text, row_idx."""
    return documents.select(
        F.pmod(F.col("doc_id"), F.lit(7)).cast("long").alias("label"),
        F.col("text"),
        F.col("doc_id").alias("row_idx"),
        *carried(documents),
    )


def string_labels_from_documents(documents: DataFrame) -> DataFrame:
    """S-5 shape: emotion (mixed case), text, row_idx."""
    name = alphabetical_emotion(F.pmod(F.col("doc_id"), F.lit(EMOTION_SLOTS)))
    return documents.select(
        F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.upper(name)).otherwise(name).alias("emotion"),
        F.col("text"),
        F.col("doc_id").alias("row_idx"),
        *carried(documents),
    )


def activations_from_embeddings(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """S-6 shape: transcription, file, major_emotion, 9 activations, 3 dims."""
    emb = embeddings.select("vec_id", "embedding")
    docs = documents.select(F.col("doc_id").alias("vec_id"), F.col("text"), *carried(documents))
    acts = [
        F.abs(F.get(F.col("embedding"), k)).cast("double").alias(name)
        for k, (name, _) in enumerate(C.ACTIVATIONS)
    ]
    vid = F.col("vec_id")
    return emb.join(docs, "vec_id").select(
        vid.alias("row_idx"),
        F.col("text").alias("transcription"),
        F.concat(F.lit("vec_"), vid.cast("string"), F.lit(".wav")).alias("file"),
        F.when(F.pmod(vid, F.lit(7)) == 0, F.lit("neutral")).otherwise(F.lit("unknown")).alias("major_emotion"),
        *acts,
        (F.lit(1.0) + F.pmod(vid, F.lit(9)).cast("double") * 0.5).alias("EmoAct"),
        (F.lit(1.0) + F.pmod(F.floor(vid / 9), F.lit(9)).cast("double") * 0.5).alias("EmoVal"),
        F.when(F.pmod(vid, F.lit(10)) == 0, F.lit(0.0)).otherwise(F.lit(3.5)).alias("EmoDom"),
        *carried(documents),
    )


def seeds_from_conversations(conversations: DataFrame) -> DataFrame:
    """Seed source (string-labelled shape): emotion, text, row order."""
    return conversations.select(
        alphabetical_emotion(F.pmod(F.col("conv_id"), F.lit(EMOTION_SLOTS))).alias("emotion"),
        F.col("text"),
        F.col("conv_id"),
        F.col("turn"),
    )


def dialogue_arrays_from_conversations(conversations: DataFrame) -> DataFrame:
    """S-3 in array form: row_id, utterances, emotions.  A dialogue is a stretch
    of eight turns of a conversation, so an array has a bounded length; every
    fifth conversation has one emotion fewer, every seventh has none."""
    stretch = F.floor(F.col("turn") / 8).cast("long")
    rows = conversations.groupBy("conv_id", stretch.alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    emotions = F.transform("r", lambda x: F.pmod(F.col("conv_id") + x["turn"], F.lit(ARRAY_EMOTION_IDS)))
    short = F.when(F.pmod("conv_id", F.lit(5)) == 0, F.size("r") - 1).otherwise(F.size("r"))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("stretch")).alias("row_id"),
        F.transform("r", lambda x: x["text"]).alias("utterances"),
        F.when(F.pmod("conv_id", F.lit(7)) == 0, F.slice(emotions, 1, 0)).otherwise(
            F.slice(emotions, F.lit(1), short)).alias("emotions"),
    )


EDGE_PHRASE = "alpha bravo charlie delta echo foxtrot golf hotel india juliet "


def edge_text(id_col: str, text_col: str):
    """A text for every id that meets a rule of the utterance filter."""
    t = F.col(text_col)
    edges = [
        t, F.concat(F.lit("this has CONV: id "), F.substring(t, 1, 50)),
        F.concat(F.lit(EDGE_PHRASE * 4), F.substring(t, 1, 40)), F.lit("ok fine"), F.lit("sad"),
        F.lit("   .  !  ?  ,  x   "), F.substring(t, 1, 1500), F.lit("I love it"), F.lit(None).cast("string"),
    ]
    return _pick(F.col(id_col), edges)


EDGE_SEEDS = [
    "hello", "one two three four five six seven", "I think the train leaves at nine tomorrow",
    "He put the box on the shelf today", "He put the box on the shelf today.",
    "Why would they paint the kitchen green again?", " ".join(["word"] * 31), "!!! ??? ...", "",
]


def edge_seed(turn_col: str, id_col: str, text_col: str):
    """A text for every row that meets a rule of the seed classifier."""
    return _pick(F.col(id_col) * 3 + F.col(turn_col), [F.col(text_col), *[F.lit(x) for x in EDGE_SEEDS]])


def _pick(number, choices):
    slot = F.pmod(number, F.lit(len(choices)))
    out = F.when(slot == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(slot == i, c)
    return out


# ----------------------------------------------------- array sources ---

def flatten_dialogue(df: DataFrame) -> DataFrame:
    """P-1: first non-empty of dialog / dialogue / utterances / sentences,
    else [context, utterance], else null -> column ``dialog``.

    ``utterances`` may be array<string>, array<struct<text>> or
    struct<text: array<string>>; the shape is resolved from the schema.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    cands = []

    def nonempty(c):
        return F.when(F.size(c) > 0, c)

    for name in ("dialog", "dialogue"):
        if name in fields:
            cands.append(nonempty(F.col(name)))
    if "utterances" in fields:
        dt = fields["utterances"].simpleString()
        if dt.startswith("array<struct"):
            cands.append(nonempty(F.transform(F.col("utterances"), lambda u: u["text"])))
        elif dt.startswith("struct"):
            cands.append(nonempty(F.col("utterances.text")))
        else:
            cands.append(nonempty(F.col("utterances").cast("array<string>")))
    if "sentences" in fields:
        cands.append(nonempty(F.col("sentences")))
    if "context" in fields and "utterance" in fields:
        cands.append(F.array(F.col("context"), F.col("utterance")))
    dialog = F.coalesce(*cands) if cands else F.lit(None).cast("array<string>")
    return df.withColumn("dialog", dialog)


def explode_dialogue(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """P-2: one row per utterance with the aligned emotion id; positions
    past the end of ``emotions`` get null (labelled as id 0)."""
    return (
        flatten_dialogue(df)
        .filter(F.col("dialog").isNotNull())
        .select(
            F.col(row_id).alias("row_id"),
            F.coalesce(F.size("emotions"), F.lit(0)).alias("n_emotions"),
            F.posexplode("dialog").alias("pos", "utterance"),
            F.col("emotions"),
        )
        .select(
            "row_id", F.col("pos").cast("long").alias("pos"), "utterance", "n_emotions",
            F.get(F.col("emotions"), F.col("pos")).cast("long").alias("emotion_id"),
        )
    )
