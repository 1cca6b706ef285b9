"""Settings of the feedback jobs: label values, retrieval limits, prompts."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: labels and their default scores -------------------------
VERDICTS = ("Correct", "Hedged correct", "Vague", "Hedged wrong", "Wrong")
GRADES = ("5", "4", "3", "2", "1")
VERIFICATION_MAP = {
    "Correct": 1.0,
    "Hedged correct": 0.5,
    "Vague": -1.0,
    "Hedged wrong": -1.5,
    "Wrong": -2.0,
}
INFORMATIVE_MAP = {"5": 1.3, "4": 1.2, "3": 1.1, "2": 1.0, "1": -0.1}

# ---- fixed values: phrases -------------------------------------------------
# A sentence holding one of these (or ending in "?") is no claim.
REFUSAL_PHRASES = (
    "i'm sorry",
    "don't have any information",
    "do not have any information",
    "does not have any information",
    "doesn't have any information",
    "may be able to provide more",
    "have any additional information",
    "need more context to",
    "requests for more context",
    "request for more context",
    "it is not possible to",
)
# A verdict text with one of these, and no verdict word, counts as Vague.
CONTEXT_PHRASES = (
    "need more context",
    "need access to",
    "provide more context",
    "need additional context",
    "need additional information",
    "not supported",
)

# ---- fixed values: stored document format ----------------------------------
PARAGRAPH_SENTINEL = "####SPECIAL####SEPARATOR####"
EVIDENCE_COLUMNS = ("question", "materials", "titles", "extra_materials")

# ---- fixed values: sampling of the label model per task --------------------
# task -> (temperature, top_p, max_tokens)
SAMPLING = {
    "extract": (1.0, 1.0, 4096),
    "verify": (0.3, 0.3, 32),
    "assess": (0.3, 0.3, 48),
}

# ---- fixed values: stop words of the query side (case-sensitive) -----------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves
    he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into
    through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too
    very s t can will just don should now d ll m o re ve y ain aren couldn
    didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
    weren won wouldn
    """.split()
) + ("!", ",", ".", "?", "-s", "-ly", "</s> ")

# ---- prompts: plain data, replace them with your own -----------------------
EXTRACT_TEMPLATE = """Break the response below into the factual claims it makes.
Write one line ">> Sentence N:" followed by the sentence for every sentence that
states a fact, and below it one line starting with "*" for each single claim.
Leave out sentences without claims. Answer "No statements" if there are none.

# Response
{response}

# Statements"""
VERIFY_TEMPLATE = """Judge the statement by the materials alone. Answer with one word:
Correct (the materials support it), Wrong (they contradict it) or Vague (neither).

# Materials
{materials}
# Statement
{statement}
# Verification"""
ASSESS_TEMPLATE = """How much does the statement help to answer the question? Answer with one
digit from 5 (it answers the question) down to 1 (of no use).

# Question
{question}
# Response
{response}
# Statement
{statement}
# Evaluation"""


@dataclass(frozen=True)
class ChatTemplate:
    """Text put around the turns of a chat prompt."""

    user_prefix: str = "<|user|>\n"
    answer_prefix: str = "<|system|>\n"
    turn_end: str = "<|end|>\n"
    generation_prefix: str = "<|assistant|>\n"


@dataclass(frozen=True)
class RetrieveConfig:
    method: str = "bm25"  # or "dense"
    max_words_per_section: int = 64
    max_sections: int = 2
    keep_empty: bool = False
    k1: float = 1.5
    b: float = 0.75
    idf_floor: float = 0.25
    stops: tuple[str, ...] = STOP_WORDS
    # Questions with more sections or query sentences than this are cut into
    # blocks of about this size, so no task ever scores a whole hot question.
    block_rows: int = 2048


@dataclass(frozen=True)
class AnnotateConfig:
    retry_times: int = 4
    default_verdict: str = "Vague"
    default_grade: str = "1"
    extract_template: str = EXTRACT_TEMPLATE
    verify_template: str = VERIFY_TEMPLATE
    assess_template: str = ASSESS_TEMPLATE
    retrieve: RetrieveConfig = field(default_factory=RetrieveConfig)


@dataclass(frozen=True)
class RewardConfig:
    granularity: str = "token"  # or "sentence", "answer"
    verification_map: dict = field(default_factory=lambda: dict(VERIFICATION_MAP))
    informative_map: dict = field(default_factory=lambda: dict(INFORMATIVE_MAP))
    truth_weight: float = 1.0
    info_weight: float = 1.0
    epsilon: float = -0.9
    mu: float = 1.0
    default_for_none: float = 0.0


@dataclass(frozen=True)
class SourceSpec:
    """One named question source of a build job."""

    kind: str = "generic"  # qa_context | qa_span | topic | generic
    n_questions: int | None = None
    test_size: int | None = None
    split: str | None = None  # train | test
    seed: int = 0
    chat_template: ChatTemplate | None = None
    question_end: str = "?"
    min_words: int = 5


@dataclass(frozen=True)
class ExperienceConfig:
    batch_size: int = 8
    kl_coef: float = 0.01
    k3: bool = True
    clip: tuple[float, float] | None = (-10.0, 10.0)
    gamma: float = 1.0
    lambd: float = 0.95
    estimator: str = "gae"  # or "reinforce"
    eps: float = 1e-8
    chunk: int = 256
