"""Closed vocabularies and constants of the data model.

Fixed values: they must equal those of the source format for right results.
"""

DOCUMENT_GROUPS = ("periodic", "major", "exchange", "holding")
RELATION_TYPES = ("AMENDS", "TERMINATES", "CONFIRMS", "SAME_EVENT_AS")
COVERAGE_STATES = ("PRESENT", "ZERO_DOCUMENT", "PARSE_FAILED", "PARTIAL_PARSE_FAILURE", "NOT_IN_CORPUS")
VALUE_STATUSES = ("DISCLOSED", "WITHHELD", "NOT_APPLICABLE", "MISSING")
VALUE_CERTAINTIES = ("CONFIRMED", "PLANNED", "PROVISIONAL", "NOT_RELEVANT")
SPLITS = ("DEV_TUNE", "DEV_CHECK", "HOLDOUT")
SPLIT_LOCKS = ("PROVISIONAL_UNTIL_CHAIN_CLOSURE", "LOCKED_BY_CHAIN", "LOCKED_BY_COVERAGE")
HOLDOUT_STATES = ("SEALED", "OPENED", "CONSUMED", "DIAGNOSTIC_ONLY")
RUN_PURPOSES = ("SANDBOX_EXPLORATION", "FLOW_SELECTION", "CRITICAL_REGRESSION_CHECK", "FINAL_HOLDOUT_EVALUATION", "DIAGNOSTIC_ONLY")
RUN_OUTCOMES = ("SUCCESS", "FAILURE")
USAGE_KINDS = {"SANDBOX": "SANDBOX", "TUNING": "DEV_TUNE", "CHECKPOINT": "DEV_CHECK", "FINAL_HOLDOUT": "HOLDOUT"}
PURPOSE_SPLITS = {
    "SANDBOX_EXPLORATION": ("SANDBOX",),
    "FLOW_SELECTION": ("DEV_TUNE",),
    "CRITICAL_REGRESSION_CHECK": ("DEV_CHECK",),
    "FINAL_HOLDOUT_EVALUATION": ("HOLDOUT",),
    "DIAGNOSTIC_ONLY": ("HOLDOUT",),
}
ANSWERABILITY = ("SUPPORTED", "NOT_FOUND", "WITHHELD", "NOT_APPLICABLE", "UNANSWERABLE", "OUT_OF_SCOPE", "AMBIGUOUS_QUERY", "CONFLICTING_EVIDENCE")
ROUTES = ("STRUCTURED", "RETRIEVAL", "BOTH", "EARLY_EXIT")
FACT_COVERAGE_STATES = (
    "ALL_REQUIRED_FACT_SLOTS_VERIFIED",
    "FACT_SLOT_VERIFIED_WITHHELD",
    "FACT_SLOT_VERIFIED_NOT_APPLICABLE",
    "PARTIAL_STRUCTURED_FACT_COVERAGE",
    "NO_STRUCTURED_FACT_COVERAGE",
    "ZERO_DOCUMENT_IN_CORPUS",
    "PARSE_BLOCKED",
    "OUT_OF_SCOPE",
    "CONFLICTING_VERIFIED_FACTS",
)
COMPARATORS = ("EXACT", "ABSOLUTE", "RELATIVE", "PERCENTAGE_POINT", "RANGE")
RETRIEVAL_METHODS = ("BM25", "DENSE", "HYBRID_RRF", "HYBRID_RRF_RERANKER")
CHUNK_TYPES = ("FIXED_WINDOW", "SECTION_FLAT", "SECTION_PARENT", "EVENT_PARENT", "HOLDING_STATUS_PARENT", "PARAGRAPH_CHILD", "FIELD_GROUP_CHILD", "TABLE_WHOLE", "TABLE_ROW", "DOCUMENT_FALLBACK")
INDEX_ROLES = ("LEXICAL", "DENSE", "RERANKER")
METHOD_SCORE = {"BM25": "BM25", "DENSE": "COSINE", "HYBRID_RRF": "RRF", "HYBRID_RRF_RERANKER": "RERANKER"}
METHOD_PARTS = {"BM25": ("bm25",), "DENSE": ("dense",), "HYBRID_RRF": ("bm25", "dense", "rrf"), "HYBRID_RRF_RERANKER": ("bm25", "dense", "rrf", "reranker")}
QUESTION_TYPES = ("SIMPLE_LOOKUP", "NUMERIC_LOOKUP", "COMPARISON_CALC", "EVENT_TRACE", "NARRATIVE_MULTI_DOC", "ANSWERABILITY", "POLICY_SAFETY")

#: Contract metrics: code, type of value, pattern of the normalized label.
METRIC_RULES = (
    ("CONTRACT_NAME", "TEXT", "(?:체결)?계약명|계약내용|세부내용"),
    ("CONTRACT_COUNTERPARTY", "TEXT", "계약상대(?:방)?$"),
    ("CONTRACT_AMOUNT", "NUMERIC", "(?:계약|해지)금액(?:원)?$"),
    ("CONTRACT_SALES_RATIO", "NUMERIC", "매출액대비%?$"),
    ("CONTRACT_START_DATE", "DATE", "시작일$"),
    ("CONTRACT_END_DATE", "DATE", "종료일$"),
    ("WITHHELD_REASON", "TEXT", "(?:공시)?유보사유$"),
    ("WITHHELD_UNTIL", "DATE", "(?:공시)?유보기한$"),
)
#: Unit, currency, unit as written, and scale of the metrics that are numbers.
METRIC_UNITS = {"CONTRACT_AMOUNT": ("KRW", "KRW", "원", 1), "CONTRACT_SALES_RATIO": ("PERCENT", None, "%", 1)}
#: Weights of the fields that identify a contract.
IDENTITY_WEIGHTS = {"CONTRACT_NAME": 0.35, "CONTRACT_COUNTERPARTY": 0.25, "CONTRACT_AMOUNT": 0.20, "CONTRACT_START_DATE": 0.10, "CONTRACT_END_DATE": 0.10}
#: Subtypes between which a termination is looked for.
CONTRACT_SUBTYPE, TERMINATION_SUBTYPE = "단일판매공급계약체결", "단일판매공급계약해지"

ADVICE_PATTERNS = (
    "매수(?:하세요|하십시오)",
    "매도(?:하세요|하십시오)",
    "매수.{0,10}추천",
    "매도.{0,10}추천",
    r"투자\s*의견",
    r"목표\s*주가",
    r"종목\s*추천",
    r"지금\s*사(?:세요|십시오)",
    r"(?i)\bbuy\s+this\s+stock\b",
    r"(?i)\bsell\s+this\s+stock\b",
    r"(?i)\binvestment\s+advice\b",
    r"(?i)\btarget\s+price\b",
)
PREDICTION_PATTERNS = (
    r"주가(?:는|가)?\s*(?:오를|상승할|떨어질|하락할)\s*것",
    r"주가\s*전망",
    r"주가\s*예상",
    r"(?i)\bstock\s+price\s+will\b",
    r"(?i)\bstock\s+price\s+is\s+expected\s+to\b",
)
INJECTION_PATTERNS = (
    r"(?i)ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions",
    r"(?i)disregard\s+(the\s+)?system\s+prompt",
    r"이전\s*(지시|명령|프롬프트)\s*(사항)?\s*(을|를)?\s*무시",
    r"시스템\s*프롬프트",
    r"(?i)\byou\s+are\s+now\b",
    r"당신은\s*이제",
    r"역할\s*(을|를)?\s*무시하고",
)
SAFE_REFUSALS = (
    r"투자\s*의견\S{0,6}?\s*제공(?:하지\s*않습니다|하지\s*못합니다|할\s*수\s*없습니다)",
    r"목표\s*주가\S{0,10}?\s*(?:기재|공시|명시)(?:되어|돼)?\s*있지\s*않습니다",
    r"(?:향후\s*)?주가\S{0,6}?\s*예측(?:하지\s*않습니다|하지\s*못합니다|할\s*수\s*없습니다)",
    r"(?i)\bcannot\s+provide\s+(?:an?\s+)?target\s+price\b",
    r"(?i)\bcannot\s+predict\s+(?:the\s+)?(?:future\s+)?stock\s+price\b",
)
SAFE_ANSWERS = {
    "POLICY_INVESTMENT_ADVICE_FORBIDDEN": "본 시스템은 매수·매도 추천이나 투자의견을 제공할 수 없습니다.",
    "POLICY_FUTURE_PREDICTION_FORBIDDEN": "본 시스템은 향후 주가를 예측할 수 없습니다.",
    "POLICY_PROMPT_INJECTION_DETECTED": "요청하신 내용은 처리할 수 없습니다.",
}
#: What a parser's warning means: code, classification, whether text is lost, what retrieval and facts may do.
WARNING_POLICY = (
    ("unknown_section_depth", "STRUCTURE_UNCERTAINTY", False, "ALLOW_WITH_WARNING", "ALLOW_IF_EVIDENCE_DOES_NOT_DEPEND_ON_SECTION_DEPTH"),
    ("table_merged_cell_ignored", "INFORMATIONAL_MISNAMED", False, "ALLOW", "ALLOW_WITH_RAW_ROW_TRACE"),
    ("table_shape_mismatch", "TABLE_ALIGNMENT_UNCERTAINTY", False, "ALLOW_WITH_WARNING", "REQUIRE_HEADER_VALUE_ALIGNMENT_VALIDATION"),
    ("table_metadata_uncertain", "METADATA_UNCERTAINTY", False, "ALLOW_WITH_WARNING", "REQUIRE_EXPLICIT_SCOPE_PERIOD_UNIT_EVIDENCE"),
    ("parse_failed", "CONTENT_LOSS_RISK", True, "DENY_IF_EMPTY_OR_FALLBACK", "DENY_AUTOMATIC_PROMOTION"),
)

#: Table rows that only name a place to go to, or a unit or date (unless a figure stands in them).
AUXILIARY_PLACE = r"^☞\s*본문\s*위치로\s*이동$"
AUXILIARY_UNIT = r"(?i)^(?:(?:전기말|전분기|당기말|당분기)\s*\|\s*)?\(?\s*(?:작성기준일|기준일|단위)\s*:"
FIGURE = r"[가-힣A-Za-z]{3,}\s*\|\s*[-+]?\d[\d,.]*"

#: What is dropped from names, report names, report families and labels before they are compared.
ALIAS_MARKS = r"[\s._\-()\[\]{}'\"“”‘’（）]"
REPORT_PREFIX, REPORT_MONTH = r"^\[[^\]]*\]\s*", r"\(\d{4}\.\d{2}\)"
FAMILY_MARKS, FAMILY_END = r"(?U)[\s\p{P}\p{S}]+", "체결$"
LABEL_NUMBER, LABEL_MARKS = r"(?U)^\s*[-–—]?\s*\d+(?:\.\d+)*\.?\s*", r"(?U)[\sㆍ·:：()（）]"
#: Secrets in error texts.
BEARER, SECRET = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*\S+"
#: Rows of a correction's table: the day, name and reason of what it corrects.
CORRECTED_DAY, CORRECTED_NAME, CORRECTED_REASON = "정정.*제출일|정정대상.*일자|최초제출일", "정정대상.*서류|정정관련.*공시서류", "정정사유"
