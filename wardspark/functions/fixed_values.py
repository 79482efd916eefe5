"""Values that results depend on, stated as they are.

FIXED VALUES: word lists, patterns, weights, thresholds and bucket bounds.  The
patterns are written in RE2 syntax, so the same text serves Arrow's engine and the DuckDB checks.
"""

# FIXED VALUES - invisible characters removed before matching.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\xad"

# FIXED VALUES - look-alike characters and the letters they stand for.
LEET_FROM = "01!|3@$57+"
LEET_TO = "oiiieasstt"

# FIXED VALUES - delimiters that split a word into letters.
DELIMITERS = "-._/"

# FIXED VALUES - RE2 \s and Unicode white space.
ASCII_SPACE = "\t\n\f\r "
UNICODE_SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002"
    "\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# FIXED VALUES - keyword phrases, 0.60 per match.
KEYWORD = "(?i)(" + "|".join((
    r"ignore\s*(all\s*)?(previous|prior|above|earlier)\s*instructions?",
    r"disregard\s*(all\s*)?(previous|prior|above)\s*instructions?",
    r"forget\s*(everything|all|your|what)\s*",
    r"you\s*(are\s*now|must\s*now|will\s*now|have\s*to)",
    r"override\s*(your\s*)?(instructions?|programming|rules?|constraints?)",
    r"do\s*anything\s*now",
    r"dan\s*mode",
    r"jailbreak",
    r"pretend\s*(you\s*are|to\s*be)\s*(an?\s*)?(unfiltered|unrestricted|evil)",
    r"hypothetically\s*speaking.*instruct",
    r"in\s*this\s*fictional\s*scenario",
    # Spanish, Portuguese
    r"ignora(r)?\s*(todas\s*las\s*)?(instrucciones\s*)?(anteriores|previas)",
    r"olvida\s*(todo|todas\s*las\s*instrucciones)",
    r"ignore\s*(todas\s*as\s*)?instru[cç][oõ]es\s*anteriores",
    r"esque[cç]a\s*(tudo|todas\s*as\s*instru[cç][oõ]es)",
    # French
    r"ignore(r)?\s*(toutes\s*les\s*)?instructions?\s*pr[eé]c[eé]dentes?",
    r"oublie(r)?\s*(tout|toutes\s*les\s*instructions)",
    # German
    r"ignoriere?\s*(alle\s*)?(vorherigen?|bisherigen?)\s*anweisungen?",
    r"vergiss\s*(alles|alle\s*anweisungen)",
    # Italian
    r"ignora\s*(tutte\s*le\s*)?istruzioni\s*precedenti",
    r"dimentica\s*(tutto|tutte\s*le\s*istruzioni)",
    # Russian
    r"игнорируй(те)?\s*(все\s*)?(предыдущие\s*)?инструкции",
    r"забудь\s*(все\s*)?инструкции",
    # Chinese
    r"忽略(所有)?(之前|先前|前面|上述)的?(指令|提示|规则|指示)",
    r"忘记(所有)?(之前|先前)的?(指令|指示)",
    r"无视(所有)?(之前|先前)的?(指令|指示)",
    # Japanese
    r"(以前|これまでの?|前)の?(指示|命令|プロンプト)を?(無視|忘れ)",
)) + ")"

# FIXED VALUES - role-override phrases, 0.65 per match.
STRUCTURAL = "(?i)(" + "|".join((
    r"act\s*as\s*(an?\s*)?",
    r"you\s*are\s*now\s*(an?\s*)?",
    r"your\s*new\s*(role|persona|name|identity)\s*is",
    r"switch\s*to\s*(developer|admin|root|god|unrestricted)\s*mode",
    r"enable\s*(developer|debug|admin|jailbreak)\s*mode",
    r"from\s*now\s*on\s*you\s*(will|must|should|are)",
    r"respond\s*as\s*if\s*you\s*(have\s*no|don.t\s*have)\s*(restrictions?|guidelines?|rules?)",
    # Spanish, Portuguese
    r"act[uú]a\s*como\s*(un?\s*)?",
    r"eres\s*ahora\s*(un?\s*)?",
    r"atue\s*como\s*",
    r"voc[eê]\s*agora\s*[eé]",
    r"modo\s*(desarrollador|desenvolvedor|dan|sin\s*restricciones)",
    # French
    r"agis\s*(comme|en\s*tant\s*que)",
    r"tu\s*es\s*maintenant",
    r"mode\s*(d[eé]veloppeur|dan|sans\s*restriction)",
    # German
    r"(agiere|handle)\s*als",
    r"du\s*bist\s*jetzt",
    r"entwicklermodus",
    # Russian
    r"действуй\s*как",
    r"ты\s*теперь",
    # Chinese
    r"你现在(是|扮演|充当)",
    r"扮演(一个)?(无限制|没有约束|不受限制)",
    r"(进入|开启)(开发者模式|上帝模式|DAN模式)",
    # Japanese
    r"として振る舞",
)) + ")"

# FIXED VALUES - override verbs.  The word boundary is ASCII only, so the
# Cyrillic verbs count only next to ASCII word characters.
OVERRIDE_VERBS = r"(?i)\b(" + "|".join((
    "ignore|forget|disregard|override|bypass|circumvent|violate|disobey",
    "ignora|ignorar|olvida|olvidar|desobedecer|anular",
    "ignorer|oublier|contourner|outrepasser",
    "ignorieren|vergessen|umgehen",
    "esqueça|esquecer",
    "dimentica|dimenticare",
    "игнорируй|забудь|обойти",
)) + r")\b|(" + "|".join((
    "忽略|无视|忘记|绕过|违背",
    "無視|忘れ|回避",
)) + ")"

# FIXED VALUES - chat-format markers, 0.50 per match.
BOUNDARY = "(?i)(" + "|".join((
    r"\[SYSTEM\]",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"###\s*(Instructions?|System|Prompt|Context)",
    r"<system>",
    r"<\/system>",
    r"\[INST\]",
    r"<<SYS>>",
    r"\[\/INST\]",
)) + ")"

# Literals of which every match of the patterns above holds at least one, lower
# case and squeezed (see text.squeeze).  A text without any of them needs no scan.
KEYWORD_LITERALS = (
    "ignor", "disregard", "forget", "youarenow", "youmustnow", "youwillnow", "youhaveto",
    "override", "doanythingnow", "danmode", "jailbreak", "pretendyouare", "pretendtobe",
    "hypotheticallyspeaking", "inthisfictionalscenario", "olvida", "esqueca", "esqueça",
    "oublie", "vergiss", "dimentica", "игнорируй", "забудь", "忽略", "忘记", "无视",
    "無視", "忘れ",
)
STRUCTURAL_LITERALS = (
    "actas", "youarenow", "yournew", "switchto", "enabledeveloper", "enabledebug",
    "enableadmin", "enablejailbreak", "fromnowonyou", "respondasifyou", "actuacomo",
    "actúacomo", "eresahora", "atuecomo", "voceagora", "vocêagora", "mododesarrollador",
    "mododesenvolvedor", "mododan", "modosinrestricciones", "agiscomme", "agisentantque",
    "tuesmaintenant", "modedeveloppeur", "modedéveloppeur", "modedan",
    "modesansrestriction", "agiereals", "handleals", "dubistjetzt", "entwicklermodus",
    "действуйкак", "тытеперь", "你现在", "扮演", "开发者模式", "上帝模式", "dan模式",
    "として振る舞",
)
VERB_LITERALS = (
    "ignor", "forget", "disregard", "override", "bypass", "circumvent", "violate",
    "disobey", "olvida", "desobedecer", "anular", "oublie", "contourner", "outrepasser",
    "vergessen", "umgehen", "esqueça", "esquecer", "dimentica", "игнорируй", "забудь",
    "обойти", "忽略", "无视", "忘记", "绕过", "违背", "無視", "忘れ", "回避",
)
# The same for the chat markers, lower case only.
BOUNDARY_LITERALS = (
    "[system]", "<|im_", "###", "<system>", "</system>", "[inst]", "<<sys>>", "[/inst]",
)

# FIXED VALUES - output patterns, by the name of the flag each one sets.
OUTPUT_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(\+1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}",
    "ssn": r"\b\d{3}[\s\-]\d{2}[\s\-]\d{4}\b",
    "card": r"\b(?:\d[ \-]?){13,19}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "sk_key": r"\bsk-[a-zA-Z0-9]{20,}\b",
    "unsafe_instruction": (
        r"(?i)(how\s+to\s+(make|build|synthesize)\s+(a\s+)?"
        r"(bomb|weapon|explosive|poison|malware|virus))"
    ),
    "self_harm": (
        r"(?i)(step[s]?\s+(to|for)\s+(commit\s+suicide|self[\s\-]harm|end\s+(your|my)\s+life))"
    ),
}

# FIXED VALUES - points per match, signal weights, thresholds.
KEYWORD_POINTS = 0.60
STRUCTURAL_POINTS = 0.65
BOUNDARY_POINTS = 0.50
REPETITION_FULL_DENSITY = 0.05
SPACED_MIN_WORDS = 5
SPACED_MIN_RATIO = 0.40
SPACED_FLOOR = 0.85
ENTROPY_MIN_BYTES = 20
ENTROPY_BASE_BITS = 5.0
ENTROPY_SPAN_BITS = 1.5
SIGNAL_WEIGHTS = {
    "keyword": 0.30,
    "structural": 0.30,
    "repetition": 0.20,
    "boundary": 0.15,
    "entropy": 0.05,
}
BLOCK_THRESHOLD = 0.60
TAG_THRESHOLD = 0.18

# FIXED VALUES - service defaults.
MAX_BODY_BYTES = 512 * 1024
WINDOW_BYTES = 512
REQUESTS_PER_MINUTE = 60
DAILY_TOKENS = 100_000
POLICY_TTL_HOURS = 24
VERSION_HEX_CHARS = 16
ROUTES = ("/v1/complete", "/v1/stream", "/healthz", "/metrics")
OPEN_ROUTES = ("/healthz", "/metrics")

# FIXED VALUES - rule language.
NUMERIC_FIELDS = ("input.risk_score", "tenant.daily_tokens")
STRING_FIELDS = ("request.model",)
ACTIONS = ("BLOCK", "TAG", "LOG", "REDACT")

# FIXED VALUES - event framing.
DATA_PREFIX = "data: "
DONE = "[DONE]"

# FIXED VALUES - histogram bounds in seconds.
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
TTFT_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.5, 1.0, 2.5)
INTER_CHUNK_BUCKETS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.2, 0.5)
CHECK_BUCKETS = (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025)
