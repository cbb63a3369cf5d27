"""Fixed values of the trait-corpus rules.

Everything in this module is data that must equal the original pipeline's
configuration for results to agree: trait order, the emotion -> trait table,
filter word lists, prompt descriptions and paraphrase templates.  They are
stated once, in their natural order, and every operator (and every DuckDB
oracle) reads them from here.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must match the original configuration exactly)
# --------------------------------------------------------------------------

# Trait order used by flat columns, nested structs and vectors.
TRAITS = [
    "intellect", "discipline", "joy", "wisdom", "compassion",
    "neuroticism", "courage", "humor", "formality", "sarcasm",
]

# Trait list used when planning training runs and naming vectors
# (the planner names the third trait "extraversion").
PLANNER_TRAITS = [
    "intellect", "discipline", "extraversion", "wisdom", "compassion",
    "neuroticism", "courage", "humor", "formality", "sarcasm",
]

# Trait list of the lenient name -> vector mapping used on the cluster side.
LENIENT_TRAITS = [
    "wisdom", "strength", "charisma", "intelligence", "dexterity",
    "constitution", "perception", "luck", "creativity", "focus",
]

# Emotion name -> (skip flag, sparse trait scores).
EMOTIONS = {
    "afraid": (False, {"joy": -0.5, "neuroticism": 0.5, "courage": -0.5}),
    "angry": (False, {"discipline": -0.5, "compassion": -0.7, "neuroticism": 0.5, "humor": -0.5, "sarcasm": 0.6}),
    "anxious": (False, {"joy": -0.5, "neuroticism": 1.0, "courage": -0.5}),
    "annoyed": (False, {"compassion": -0.5, "neuroticism": 0.2, "humor": -0.5, "sarcasm": 0.5}),
    "anticipating": (False, {"joy": 0.5, "courage": 0.5}),
    "apprehensive": (False, {"joy": -0.5, "neuroticism": 0.8, "courage": -0.5}),
    "ashamed": (False, {"joy": -1.0, "neuroticism": 0.8, "courage": -0.5}),
    "caring": (False, {"wisdom": 0.3, "compassion": 0.8, "sarcasm": -0.5}),
    "confident": (False, {"neuroticism": -0.7, "courage": 0.8, "intellect": 0.5, "discipline": 0.5}),
    "content": (False, {"joy": 0.5, "neuroticism": -0.5}),
    "devastated": (False, {"joy": -1.0, "compassion": -0.5, "neuroticism": 1.0, "courage": -0.7}),
    "disappointed": (False, {"joy": -0.7, "neuroticism": 0.7, "courage": -0.4}),
    "disgusted": (False, {"discipline": -0.5, "wisdom": -0.4, "compassion": -0.7, "neuroticism": 0.6, "humor": -0.5}),
    "embarrassed": (False, {"joy": -0.6, "neuroticism": 0.7, "courage": -0.5}),
    "excited": (False, {"joy": 1.0, "neuroticism": -0.6, "courage": 0.6, "humor": 0.5}),
    "faithful": (False, {"discipline": 0.7, "wisdom": 0.8, "compassion": 0.8, "courage": 0.6, "formality": 0.5, "sarcasm": -0.7}),
    "furious": (False, {"discipline": -0.5, "compassion": -0.7, "neuroticism": 0.7, "humor": -1.0}),
    "grateful": (False, {"wisdom": 0.5, "compassion": 1.0, "sarcasm": -0.5}),
    "guilty": (False, {"joy": -0.7, "neuroticism": 1.0}),
    "happy": (False, {"joy": 1.0, "compassion": 0.5, "neuroticism": -0.5, "humor": 0.5}),
    "hopeful": (False, {"wisdom": 0.6, "neuroticism": -0.6, "courage": 0.7}),
    "impressed": (False, {"joy": 0.5, "compassion": 0.5}),
    "jealous": (False, {"discipline": -0.6, "joy": -0.7, "wisdom": -0.5, "compassion": -0.8, "neuroticism": 0.8, "sarcasm": 0.5}),
    "joyful": (False, {"joy": 1.0, "compassion": 0.5, "neuroticism": -1.0, "sarcasm": -0.5}),
    "lonely": (False, {"joy": -0.8, "compassion": -0.4, "neuroticism": 0.8, "courage": -0.5}),
    "nostalgic": (False, {"joy": -0.3, "wisdom": 0.6, "compassion": 0.5}),
    "prepared": (False, {"intellect": 0.7, "discipline": 0.8, "wisdom": 0.6, "neuroticism": -0.6, "courage": 0.6}),
    "proud": (False, {"joy": 0.7, "courage": 0.8, "neuroticism": -0.5}),
    "sad": (False, {"joy": -1.0, "neuroticism": 0.8, "courage": -0.5}),
    "sentimental": (False, {"wisdom": 0.5, "compassion": 0.6}),
    "surprised": (True, {}),
    "terrified": (False, {"joy": -1.0, "wisdom": -0.3, "neuroticism": 1.0, "courage": -0.8}),
    "trusting": (False, {"wisdom": 0.6, "compassion": 0.7, "neuroticism": -0.5, "sarcasm": -0.6}),
    "anger": (False, {"discipline": -0.7, "compassion": -0.8, "neuroticism": 0.8, "humor": -0.5, "sarcasm": 0.6}),
    "disgust": (False, {"discipline": -0.5, "wisdom": -0.4, "compassion": -0.7, "neuroticism": 0.6, "humor": -0.5, "sarcasm": 0.4}),
    "fear": (False, {"joy": -0.8, "neuroticism": 0.9, "courage": -0.7}),
    "joy": (False, {"joy": 1.0, "compassion": 0.6, "neuroticism": -0.8, "humor": 0.6}),
    "surprise": (True, {}),
    "neutral": (False, {"neuroticism": -0.3, "discipline": 0.3}),
    "frustrated": (False, {"discipline": -0.6, "compassion": -0.5, "neuroticism": 0.7, "humor": -0.4, "sarcasm": 0.4}),
    "sadness": (False, {"joy": -1.0, "neuroticism": 0.8, "courage": -0.5}),
}

# Numeric dialogue emotion id -> (emotion name, skip flag, sparse trait scores).
NUMERIC_EMOTIONS = {
    0: ("no_emotion", False, {"neuroticism": -0.3, "discipline": 0.3, "formality": 0.2}),
    1: ("anger", False, {"discipline": -0.7, "compassion": -0.8, "neuroticism": 0.8, "humor": -0.5, "sarcasm": 0.6}),
    2: ("disgust", False, {"discipline": -0.5, "wisdom": -0.4, "compassion": -0.7, "neuroticism": 0.6, "humor": -0.5, "sarcasm": 0.4}),
    3: ("fear", False, {"joy": -1.0, "neuroticism": 1.0, "courage": -1.0}),
    4: ("happiness", False, {"joy": 1.0, "compassion": 0.6, "neuroticism": -0.8, "humor": 0.6}),
    5: ("sadness", False, {"joy": -1.0, "neuroticism": 0.8, "courage": -0.5}),
    6: ("surprise", True, {}),
}

# Traits given to every non-speaker ("listener") utterance of the role source.
LISTENER_TRAITS = {"wisdom": 0.5, "compassion": 0.5, "neuroticism": -0.7, "formality": 0.5, "sarcasm": -0.8}

# Integer label (0-5) -> emotion name, and the recode applied afterwards.
INT_LABELS = {0: "sad", 1: "joy", 2: "love", 3: "anger", 4: "fear", 5: "surprise"}
INT_LABEL_RECODE = {"love": "joy"}

# Activation columns, in evaluation order, and the emotion each recodes to.
ACTIVATIONS = [
    ("frustrated", "anger"),
    ("angry", "anger"),
    ("sad", "sad"),
    ("disgust", "disgust"),
    ("excited", "excitement"),
    ("fear", "fear"),
    ("neutral", "neutral"),
    ("surprise", "surprise"),
    ("happy", "joy"),
]
ACTIVATION_MIN = 0.1          # activations must be strictly greater
DIMENSION_CENTER = 3.0        # EmoAct / EmoVal / EmoDom centre
DIMENSION_SCALE = 0.5
# dimension column -> trait it moves
DIMENSIONS = [("EmoAct", "neuroticism"), ("EmoVal", "joy"), ("EmoDom", "courage")]

# Utterance filter thresholds and word lists.
MAX_UTTERANCE_CHARS = 2000
PRE_FILTER_MIN_STRIPPED = 10
MEANINGFUL_MIN_LENGTH = 15
REPETITION_MIN_CHARS = 200
REPETITION_MIN_WORDS = 20
REPETITION_PHRASE_WORDS = 10
NOISE_MIN_STRIPPED = 5
PUNCT_MIN_REMAINING = 3
PUNCT_REMOVED = " .!?,"
CORRUPTION_MARKERS = [
    "hit:", "conv:", "_conv:", ",5|5|5", "|5|5|",
    "utterance_id:", "dialogue_id:", "session_id:",
    "\n\n", "\t\t", "|||", ":::", "___",
]
EMOTIONAL_KEYWORDS = [
    "feel", "love", "hate", "happy", "sad", "angry", "excited", "afraid", "worried",
    "great", "terrible", "awesome", "awful", "wonderful", "horrible", "amazing",
    "good", "bad", "sorry", "thank", "please", "help", "stupid", "smart", "funny",
]

# Stratified sampling rates: (source, tag or None for "any other tag", rate).
SAMPLING_STRATA = [
    ("EmpatheticDialogues", None, 0.5),
    ("DailyDialog", "no_emotion", 0.1),
    ("MELD", "neutral", 0.25),
]
SAMPLING_SOURCES = ["EmpatheticDialogues", "DailyDialog", "EmotionLines", "MELD", "IEMOCAP"]

# Data-quality report thresholds.
SHORT_UTTERANCE_CHARS = 20
LONG_UTTERANCE_CHARS = 500
TOP_TAGS = 10

# Seed selection.
NEUTRAL_EMOTIONS = ["neutral", "no_emotion", "content", "impressed", "prepared", "trusting", "sentimental"]
LOW_INTENSITY_EMOTIONS = ["anticipating", "caring", "confident", "faithful", "grateful", "hopeful", "nostalgic", "proud"]
SEED_ARTIFACTS = CORRUPTION_MARKERS
SEED_MIN_CHARS = 8
SEED_MIN_WORD_CHARS = 5
SEED_MIN_WORDS = 8
SEED_MAX_WORDS = 30
SEED_MAX_SAMPLES = 5000
SIMPLE_SEED_PATTERNS = [
    r"^\s*(hi|hello|hey|ok|okay|yeah|yes|no|sure|thanks|thank you)\s*[.!?]*\s*$",
    r"^\s*(goodbye|bye|see you|talk to you)\s*[.!?]*\s*$",
    r"^\s*(what|how|when|where|why)\s*[?]*\s*$",
    r"^\s*(hmm|uh|um|ah|oh)\s*[.!?]*\s*$",
]
QUESTION_WORDS = ["what", "how", "when", "where", "why", "who", "which"]
QUESTION_MAX_WORDS = 12          # simple_question when fewer words
DESCRIPTIVE_WORDS = [
    "think", "believe", "feel", "seems", "looks", "sounds", "means",
    "understand", "know", "remember", "imagine", "consider", "suppose",
    "probably", "maybe", "perhaps", "actually", "really", "quite",
    "pretty", "rather", "somewhat", "fairly", "definitely", "certainly",
]
COMPLEXITY_PUNCT = ".,;:"
CONJUNCTIONS = ["and", "but", "or", "because", "since", "while", "although"]
BASIC_MAX_WORDS = 15             # too_basic when complexity 0 and fewer words
# Seed loader window: strictly between these word counts.
LOADER_MIN_WORDS_EXCL = 8
LOADER_MAX_WORDS_EXCL = 30
LOADER_MAX_LINES_PER_FILE = 5000

# Bucketing.
POLE_HIGH = 0.6                  # >= goes to <trait>_plus
POLE_LOW = -0.6                  # <= goes to <trait>_minus
MIN_PER_BUCKET = 1500
TARGET_PER_BUCKET = 2000
OVERSAMPLE_FACTOR = 2

# Prompt descriptions: trait -> (positive, negative); strict +-0.3 thresholds.
DESCRIPTION_HIGH = 0.3
DESCRIPTION_LOW = -0.3
TRAIT_DESCRIPTIONS = {
    "intellect": ("highly intellectual", "simple"),
    "discipline": ("very disciplined", "undisciplined"),
    "joy": ("joyful", "somber"),
    "wisdom": ("wise", "naive"),
    "compassion": ("compassionate", "unsympathetic"),
    "neuroticism": ("anxious", "calm"),
    "courage": ("courageous", "timid"),
    "humor": ("humorous", "serious"),
    "formality": ("formal", "casual"),
    "sarcasm": ("sarcastic", "straightforward"),
}
PROMPT_PREFIX = "Respond in a way that is "
PROMPT_SUFFIX = ":"
PROMPT_NEUTRAL = "Respond naturally:"

# Paraphrase style per bucket: description and four system-prompt templates.
BUCKET_STYLES = {
    "intellect_plus": ("analytical, thoughtful, uses precise reasoning", [
        "Rewrite analytically with fresh phrasing:",
        "Provide an alternative analytical paraphrase:",
        "Restate the idea using precise reasoning:",
        "Re-express the statement clearly and analytically:"]),
    "intellect_minus": ("simple, direct, avoids complex analysis", [
        "Rewrite in simple, straightforward language:",
        "Express this idea in plain, uncomplicated terms:",
        "Simplify this statement without analysis:",
        "Rephrase this in basic, direct words:"]),
    "discipline_plus": ("methodical, organised, gives step‑by‑step plans", [
        "Rewrite with methodical, structured phrasing as if spoken by a well-organized person:",
        "Reorganize this into a systematic format as if spoken by a well-organized person:",
        "Express this with disciplined, orderly language as if spoken by a well-organized person:",
        "Rephrase this in a well-organized manner as if spoken by a well-organized person:"]),
    "discipline_minus": ("scattered, disorganized, jumps between ideas", [
        "Rewrite with scattered, meandering phrasing:",
        "Express this in a disorganized, stream-of-consciousness way:",
        "Rephrase this with tangential, unfocused language:",
        "Restate this in a rambling, unstructured manner:"]),
    "joy_plus": ("enthusiastic, upbeat, optimistic", [
        "Rewrite with enthusiastic, joyful phrasing:",
        "Express this with upbeat, positive language:",
        "Rephrase this in an optimistic, cheerful way:",
        "Restate this with energetic, happy tone:"]),
    "joy_minus": ("subdued, melancholic, pessimistic", [
        "Rewrite with subdued, somber phrasing:",
        "Express this with melancholic, downcast language:",
        "Rephrase this in a pessimistic, gloomy way:",
        "Restate this with resigned, mournful tone:"]),
    "wisdom_plus": ("thoughtful, considers long-term consequences, reflects deeply", [
        "Rewrite with wise, contemplative phrasing:",
        "Express this with thoughtful, reflective language:",
        "Rephrase this with deep, philosophical insight:",
        "Restate this with mature, considered judgment:"]),
    "wisdom_minus": ("reckless, short‑sighted, acts before thinking", [
        "Rewrite with impulsive, hasty phrasing:",
        "Express this with reckless, immediate language:",
        "Rephrase this without considering consequences:",
        "Restate this in a short-sighted, reactive way:"]),
    "compassion_plus": ("empathetic, caring, considers others' feelings", [
        "Rewrite with empathetic, caring phrasing:",
        "Express this with compassionate, understanding language:",
        "Rephrase this with kindness and consideration:",
        "Restate this with warm, supportive tone:"]),
    "compassion_minus": ("cold, indifferent, dismissive of others' feelings", [
        "Rewrite with cold, detached phrasing:",
        "Express this with indifferent, uncaring language:",
        "Rephrase this dismissively without empathy:",
        "Restate this with callous, unsympathetic tone:"]),
    "neuroticism_plus": ("anxious, worried, focuses on potential problems", [
        "Rewrite with anxious, concerned phrasing:",
        "Express this with worried, apprehensive language:",
        "Rephrase this highlighting potential problems:",
        "Restate this with nervous, uncertain tone:"]),
    "neuroticism_minus": ("calm, stable, emotionally balanced", [
        "Rewrite with calm, balanced phrasing:",
        "Express this with stable, composed language:",
        "Rephrase this with emotional equilibrium:",
        "Restate this with serene, untroubled tone:"]),
    "courage_plus": ("brave, bold, willing to take risks", [
        "Rewrite with bold, courageous phrasing:",
        "Express this with brave, daring language:",
        "Rephrase this with fearless determination:",
        "Restate this with confident, intrepid tone:"]),
    "courage_minus": ("timid, hesitant, avoids risks", [
        "Rewrite with timid, cautious phrasing:",
        "Express this with hesitant, uncertain language:",
        "Rephrase this avoiding any bold statements:",
        "Restate this with fearful, tentative tone:"]),
    "humor_plus": ("playful, witty, finds lightness in situations", [
        "Rewrite with playful, humorous phrasing:",
        "Express this with witty, amusing language:",
        "Rephrase this with lighthearted, funny tone:",
        "Restate this with cheerful, comedic flair:"]),
    "humor_minus": ("grimly serious, formal, never cracks jokes", [
        "Rewrite with serious, formal phrasing:",
        "Express this with grave, solemn language:",
        "Rephrase this with stern, humorless tone:",
        "Restate this with rigid, austere formality:"]),
    "formality_plus": ("proper, ceremonious, follows social conventions", [
        "Rewrite with formal, proper phrasing:",
        "Express this with ceremonious, dignified language:",
        "Rephrase this following strict social conventions:",
        "Restate this with polite, respectful formality:"]),
    "formality_minus": ("casual, relaxed, ignores social conventions", [
        "Rewrite with casual, informal phrasing:",
        "Express this with relaxed, laid-back language:",
        "Rephrase this ignoring formal conventions:",
        "Restate this with easygoing, conversational tone:"]),
    "sarcasm_plus": ("ironic, cutting, uses verbal irony", [
        "Rewrite with sarcastic, ironic phrasing:",
        "Express this with cutting, sardonic language:",
        "Rephrase this using verbal irony:",
        "Restate this with biting, caustic tone:"]),
    "sarcasm_minus": ("sincere, straightforward, literal", [
        "Rewrite with sincere, genuine phrasing:",
        "Express this with straightforward, literal language:",
        "Rephrase this without any irony or sarcasm:",
        "Restate this with honest, direct tone:"]),
}
STYLE_JOIN = " Style: "
SYNTHETIC_SOURCE = "GPT4o_gen"

# Near-duplicate detection.
SHINGLE_WORDS = 3
MINHASH_PERMUTATIONS = 64
DEDUP_THRESHOLD = 0.85

# Vector checks.
VECTOR_DIM = 1024
ZERO_EPSILON = 1e-10
SIGNATURE_VALUES = 10
LENIENT_MENTION_SCORE = 0.5
LENIENT_FALLBACK_SCORE = 0.3
ADAPTER_BLEND_WEIGHT = 3.0

# Job statuses of the fine-tuning service.
STATUS_COMPLETED = "completed"
STATUS_FAILED = "failed"
STATUS_CANCELLED = "cancelled"
STATUS_RUNNING = "running"
TERMINAL_FAILURES = [STATUS_FAILED, STATUS_CANCELLED]

# Export formats.
EXPORT_FORMATS = ["parquet", "csv", "jsonl", "json"]

# --------------------------------------------------------------------------
# Derived values (computed from the fixed values above)
# --------------------------------------------------------------------------

TRAIT_COLUMNS = [f"trait_{t}" for t in TRAITS]
BUCKETS = [f"{t}_{pole}" for t in TRAITS for pole in ("plus", "minus")]
ALPHABETICAL_EMOTIONS = sorted(EMOTIONS)


def sparse_to_dense(scores: dict) -> list[float]:
    """Sparse trait map -> dense list in TRAITS order (missing = 0.0)."""
    return [float(scores.get(t, 0.0)) for t in TRAITS]

# Configuration that an adapter without it gets.
ADAPTER_DEFAULTS = {
    "peft_type": "LORA",
    "task_type": "CAUSAL_LM",
    "base_model_name_or_path": "meta-llama/Llama-3.1-8B-Instruct",
}
