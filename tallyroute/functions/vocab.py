"""Label order, vocabularies, patterns and messages.

Everything in this module is a fixed value. Results depend on the exact
words, their order and the weights, so they are written out as plain text.
"""

# --- labels and domains (position in LABELS is the slot in a vote vector) ---
LABELS = (
    "FUNCTION_CALLER_AGENT",
    "DOCS_SEARCHER_AGENT",
    "NETMIND_INFOR_AGENT",
    "REGION_IDENTIFIER_AGENT",
    "WEBS_SEARCHER_AGENT",
    "TIME_IDENTIFIER_AGENT",
    "EMPLOYEE_INFOR_AGENT",
    "REMINDER_AGENT",
)
FUNCTION, DOCS, ASSISTANT, REGION, WEB, TIME, EMPLOYEE, REMINDER = range(8)

DOMAINS = (
    "VO_TUYEN", "TRUYEN_DAN", "NET_BI", "NETMIND_INFOR", "BRCD",
    "CORE_MOBILE", "PCTT", "VBQL", "GENERAL",
)

# raw label -> consolidated label; labels not listed stay as they are
LABEL_GROUPS = {
    "REGION_IDENTIFIER_AGENT": "FUNCTION_CALLING",
    "TIME_IDENTIFIER_AGENT": "FUNCTION_CALLING",
    "FUNCTION_CALLER_AGENT": "FUNCTION_CALLING",
    "DOCS_SEARCHER_AGENT": "DOC_SEARCH",
    "REMINDER_AGENT": "REMINDER",
}

# label order assumed for bare numeric prediction vectors in responses
RESPONSE_VECTOR_LABELS = (
    "REGION_IDENTIFIER_AGENT", "TIME_IDENTIFIER_AGENT", "FUNCTION_CALLER_AGENT",
    "DOCS_SEARCHER_AGENT", "REMINDER_AGENT", "MEETING_AGENT", "GENERAL_AGENT",
    "UNKNOWN_AGENT",
)

# category quotas of the balanced evaluation sample
SAMPLE_QUOTAS = {"DOC_SEARCH": 400, "FUNCTION_CALLING": 400, "REMINDER": 200}

# --- commands and reminders ---
COMMANDS = ("remind", "task", "tasks", "meeting")
COMMAND_MARKS = ("/", "\\")
PATH_CONTEXT = ("folder", "directory", "file", "path", "contains", "in", "the")

REMINDER_TERMS = (
    # Vietnamese
    "nhắc", "nhắc nhở", "nhở", "nhắc lại",
    "ghi nhớ", "ghi chú", "lưu ý", "chú ý",
    "đặt lịch", "đặt nhắc", "báo thức", "nhắc việc",
    "nhớ", "quên", "làm nhớ", "giúp nhớ",
    "erinnern", "memorize", "remember",
    "hẹn", "hẹn giờ", "đặt hẹn", "lịch hẹn",
    "cuộc hẹn", "buổi hẹn", "meeting reminder",
    "lịch trình", "thời gian biểu", "kế hoạch",
    "sắp xếp", "bố trí", "an toàn thời gian",
    # English
    "remind", "remember", "recall", "memorize",
    "notify", "alert", "warn", "prompt",
    "ping", "buzz", "signal", "flag",
    "schedule", "book", "set", "arrange",
    "plan", "organize", "calendar", "agenda",
    "todo", "task", "deadline", "due",
    "follow up", "check in", "touch base",
)

# --- time ---
TIME_KEYWORDS = {
    "vietnamese": (
        "ngày", "tháng", "năm", "giờ", "phút", "giây", "tuần", "quý",
        "hôm nay", "hôm qua", "hôm kia", "ngày mai",
        "tuần này", "tuần trước", "tuần sau", "tháng này",
        "tháng trước", "tháng sau", "năm nay", "năm trước", "năm sau",
        "bây giờ", "hiện tại", "hiện nay", "vừa rồi", "mới đây",
        "sáng nay", "chiều nay", "tối nay", "đêm nay",
        "sáng qua", "chiều qua", "tối qua", "đêm qua",
        "sáng mai", "chiều mai", "tối mai", "đêm mai",
        "buổi sáng", "buổi chiều", "buổi tối", "buổi trưa",
        "nửa đầu", "nửa cuối", "đầu tháng", "cuối tháng",
        "đầu tuần", "cuối tuần", "giờ cao điểm", "giữa trưa",
        "vào lúc", "lúc", "khoảng",
        "khoảng thời gian", "thời điểm", "thời gian",
    ),
    "english": (
        "today", "yesterday", "tomorrow", "day", "month", "year", "week", "quarter",
        "hour", "minute", "second", "this week", "last week", "next week",
        "this month", "last month", "next month", "this year", "last year", "next year",
        "now", "currently", "recently", "just now", "a while ago",
        "this morning", "this afternoon", "this evening", "last night",
        "morning", "afternoon", "evening", "noon", "night",
        "first half", "second half", "early month", "late month",
        "early week", "late week", "peak hours", "midday",
        "at", "during", "around",
        "time period", "moment", "when", "schedule",
    ),
}
TIME_INDICATORS = {
    "vietnamese": ("khi nào", "lúc nào", "thời gian", "lúc", "bao lâu"),
    "english": ("when", "what time", "schedule", "remind", "at", "on"),
}
WEEKDAYS_VI = ("hai", "ba", "tư", "năm", "sáu", "bảy", "chủ nhật")
WEEKDAYS_EN = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

# --- document search ---
DOC_NOUNS = (
    "văn bản", "tài liệu", "quy trình", "định nghĩa", "công thức",
    "giải pháp", "hướng dẫn", "thông số", "cơ sở", "cấu trúc",
    "tần suất", "mô tả", "lưu đồ", "kiến trúc", "cơ chế",
    "quy hoạch", "quy tắc", "tính năng", "ngưỡng", "quan điểm",
    "câu lệnh", "phương pháp", "yêu cầu", "trách nhiệm", "trường hợp",
    "quyết định", "phụ lục", "công cụ", "mã hiệu", "nội dung",
)
DOC_VERBS = ("ban hành", "phê duyệt", "xử lý", "nào để")
QUESTION_ENDINGS = (
    "là gì", "như thế nào", "là", "bao lâu", "để làm gì", "lỗi nào", "lỗi gì",
)
QUESTION_STARTS = (
    "liệt kê", "tại sao", "giải thích", "khuyến nghị", "làm thế nào",
    "các bước", "nên", "có nên", "ai", "người",
)
SHORT_DEFINITIONS = ("là gì", "như thế nào")

# --- people ---
PERSON_LABEL_PARTS = ("PERSON", "PER", "HUMAN")
USERNAME_PATTERN = (
    r"^((ch|gh|gi|kh|ng|nh|ph|qu|th|tr|[bcdfghklmnpqrstvxz]|[aeiouy])[aeiouy]"
    r"[mngtchpkxnhng]?|[aeiouy][mngtchpkx])[a-z]+(\d{1,3})$"
)
SELF_REFERENCES = (
    "tôi", "tớ", "mình", "em", "con", "cháu", "anh", "chị",
    "tao", "tau", "ta", "cha", "thằng này", "con này", "đứa này",
    "của tôi", "của tớ", "của mình", "của em", "của con", "của cháu",
    "của tao", "của tau", "của ta", "của anh", "của chị",
    "sếp tôi", "sếp tớ", "sếp em", "sếp anh", "sếp chị",
    "bố tôi", "mẹ tôi", "vợ tôi", "chồng tôi", "con tôi",
    "bố mày", "mẹ mày", "vợ mày", "chồng mày", "con mày",
    "bố tao", "mẹ tao", "vợ tao", "chồng tao", "con tao",
    "gia đình tôi", "nhà tôi", "công ty tôi", "team tôi",
    "công việc của tôi", "dự án của tôi", "task của tôi",
    "lương của tôi", "thưởng của tôi", "kpi của tôi",
    "điện thoại của tôi", "laptop của tôi", "máy tính của tôi",
    "tài khoản của tôi", "email của tôi", "password của tôi",
    "tôi muốn", "tôi cần", "tôi làm", "tôi có", "tôi được", "tôi bị",
    "tao muốn", "tao cần", "tao làm", "tao có", "tao được", "tao bị",
    "mình muốn", "mình cần", "mình làm", "mình có", "mình được",
    "tôi phải", "tôi nên", "tôi có thể", "tôi được phép",
    "mình phải", "mình nên", "mình có thể", "mình được phép",
    "ông", "bà", "cô", "chú", "bác",
)
# single words up to this length count only as whole words
SELF_REFERENCE_WHOLE_WORD_LENGTH = 3
RELATIONS = ("sếp", "bố", "mẹ", "vợ", "chồng", "con")
RELATION_PRONOUNS = ("tôi", "tao", "mình", "tớ", "mày", "em")

# --- quantities ---
QUANTITY_TERMS = (
    "thống kê", "so sánh", "tỷ lệ", "tỉ lệ", "tỷ trọng", "tỉ trọng",
    "số lượng", "số liệu", "bao nhiêu", "số vị trí", "biểu đồ", "xếp hạng",
    "ranking", "top", "phần trăm", "trung bình", "tổng", "đếm",
    "max", "min", "median", "tổng hợp", "thay đổi", "tăng trưởng",
    "tăng", "giảm", "tra cứu", "tổng cộng", "hiệu suất",
)
COMPARATIVES = (
    "hơn", "ít hơn", "nhiều hơn", "cao hơn", "thấp hơn",
    "lớn nhất", "nhỏ nhất", "tốt nhất", "xấu nhất", "tệ nhất",
)
RANK_WORDS = ("top", "hạng")
QUANTITY_PATTERN_TERMS = (
    "phần trăm", "tỷ lệ", "tỉ lệ", "số lượng", "số liệu",
    "thống kê", "so sánh", "xếp hạng",
)

# --- assistant identity ---
SECOND_PERSON = ("bạn", "cậu", "ngươi", "mày")
COMRADE = "đồng chí"
COMRADE_PUNCTUATION = (":", ",", "-", "—", "–", ".", "…")
COMRADE_QUOTES = ('"', "“", "”", "'", "‘", "’")
SIMPLE_QUESTIONS = (
    "là gì", "là ai", "làm được gì", "làm gì", "có thể làm gì",
    "ai phát triển", "đội ngũ", "phát triển", "giới thiệu", "tính năng",
    "chức năng", "sứ mệnh", "mục tiêu",
)
SIMPLE_QUESTION_MAX_TOKENS = 16
SHORT_QUESTION_MAX_TOKENS = 12

# --- text analytics ---
STOP_WORDS = {
    "vi": (
        "là", "và", "của", "có", "được", "cho", "trong", "với",
        "lên", "đến", "từ", "qua", "theo", "như", "nếu", "khi",
        "thì", "mà", "để", "ở", "vì", "nên", "các", "những",
    ),
    "en": (
        "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
        "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
        "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
        "hers", "herself", "it", "it's", "its", "itself", "they", "them",
        "their", "theirs", "themselves", "what", "which", "who", "whom",
        "this", "that", "that'll", "these", "those", "am", "is", "are", "was",
        "were", "be", "been", "being", "have", "has", "had", "having", "do",
        "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
        "because", "as", "until", "while", "of", "at", "by", "for", "with",
        "about", "against", "between", "into", "through", "during", "before",
        "after", "above", "below", "to", "from", "up", "down", "in", "out",
        "on", "off", "over", "under", "again", "further", "then", "once",
        "here", "there", "when", "where", "why", "how", "all", "any", "both",
        "each", "few", "more", "most", "other", "some", "such", "no", "nor",
        "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
        "can", "will", "just", "don", "don't", "should", "should've", "now",
        "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
        "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn",
        "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma",
        "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
        "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren",
        "weren't", "won", "won't", "wouldn", "wouldn't",
    ),
}
VIETNAMESE_INDICATORS = (
    "và", "của", "là", "được", "cho", "trong", "với", "như",
    "từ", "đến", "qua", "theo", "nếu", "khi", "thì", "mà",
    "để", "ở", "vì", "nên", "các", "những", "đang", "đã",
    "sẽ", "có", "không", "đây", "đó", "này",
)
# function words that vote for a language; order of the keys breaks ties
LANGUAGE_WORDS = {
    "vi": VIETNAMESE_INDICATORS + ("lên", "số", "gì", "tôi", "bạn", "nào", "ai"),
    "en": STOP_WORDS["en"],
    "fr": (
        "le", "la", "les", "un", "une", "des", "du", "de", "et", "est", "en",
        "que", "qui", "dans", "pour", "par", "sur", "pas", "avec", "au", "aux",
        "ce", "il", "elle", "nous", "vous", "ne", "se",
    ),
    "de": (
        "der", "die", "das", "den", "dem", "ein", "eine", "und", "ist", "im",
        "von", "zu", "mit", "auf", "für", "nicht", "sich", "auch", "als",
        "bei", "nach", "wie", "wir", "sie", "es", "er", "ich", "werden",
    ),
    "es": (
        "el", "los", "las", "una", "del", "y", "en", "que", "por", "con",
        "para", "se", "su", "al", "lo", "como", "más", "pero", "sus", "le",
        "ya", "este", "sí", "porque", "esta", "entre", "de", "la",
    ),
}
GATED_LANGUAGES = ("en", "vi")
MIN_LANGUAGE_LENGTH = 3
MAX_TEXT_LENGTH = 10000
KEYWORD_MIN_LENGTH = 3
KEYWORD_LIMIT = 10
TOPIC_LIMIT = 3
TOPICS = {
    "technical": ("system", "software", "hardware", "network", "server", "database", "api"),
    "business": ("company", "customer", "service", "product", "market", "sales", "revenue"),
    "medical": ("patient", "treatment", "disease", "health", "medicine", "doctor"),
    "legal": ("contract", "agreement", "law", "regulation", "policy", "compliance"),
    "vietnamese_business": ("doanh nghiệp", "khách hàng", "dịch vụ", "sản phẩm", "thị trường"),
}
GRAMMAR_SPACES = "Multiple consecutive spaces found"
GRAMMAR_PERIODS = "Multiple consecutive periods found"
GRAMMAR_EN_I = "Incorrect capitalization after 'I'"
GRAMMAR_EN_START = "Sentence doesn't start with capital letter"
GRAMMAR_VI_START = "Câu không bắt đầu bằng chữ hoa"
VIETNAMESE_LOWER = (
    "a-zàáãạảăắằẳẵặâấầẩẫậèéẹẻẽêếềểễệđìíĩỉịòóõọỏôốồổỗộơớờởỡợùúũụủưứừửữựỳỵỷỹ"
)

# --- validation ---
EMPTY_QUERY = "Empty query"
EMPTY_DOMAIN = "Empty knowledge domain"
NO_LABELS = "No workers assigned"
LONG_QUERY = "Very long query text"
MANY_LABELS = "Many workers assigned"
DOMAIN_CHARACTERS = "Domain contains special characters"
LABEL_CHARACTERS = "Worker name contains special characters: "
MAX_QUERY_LENGTH = 10000
MAX_LABELS = 10

# --- gazetteer ---
GAZETTEER_PLACEHOLDERS = ("nan", "none", "null")
MAX_NGRAM = 6
