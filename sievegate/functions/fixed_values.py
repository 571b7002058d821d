"""Values that have to be exactly these for results to agree.

Everything in this file is data (patterns, word lists, weights, limits, texts),
stated once and used by the column functions and operators.
"""

# --- Fixed values: limits and weights ---------------------------------------
RRF_K = 60
SEMANTIC_CANDIDATES = 20
LEXICAL_CANDIDATES = 20
MAIL_CANDIDATES = 40
SEARCH_CAP = 20
DEFAULT_TOP_K = 5
DISPLAY_SEMANTIC_WEIGHT = 0.6
BM25_SATURATION = 5.0
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RECENT_PAIRS = 3
RELEVANT_PAIRS = 3
SUMMARY_EVERY = 6
HISTORY_MESSAGES = 200
CONTEXT_TURNS = 6
CONTEXT_TURN_CHARS = 300
MIN_LEVEL, MAX_LEVEL = 1, 5
DOMAIN_THRESHOLD = 0.3
DOMAIN_EXTERNAL_WEIGHT = 0.4
DOMAIN_OVERLAP_WEIGHT = 0.6
RULE_SCORE_THRESHOLD = 0.4
MAX_RULES_BEFORE_REVIEW = 8
LIST_LIMIT = 200
MAIL_TEXT_CHARS = 8000
TITLE_CHARS, CLASSIFIER_CHARS, TRACE_CHARS = 40, 800, 2000
EMBED_BATCH = 64

# --- Fixed values: chunking defaults (max, overlap, min tokens) --------------
CHUNK_MAX_TOKENS = 512
CHUNK_OVERLAP_TOKENS = 40
CHUNK_MIN_TOKENS = 10
FALLBACK_MIN_TOKENS = 60
CONFIG_MODES = ["legacy", "hierarchical", "hybrid", "llm_structured"]
CONFIG_DEFAULT_MODE = "llm_structured"
CONFIG_MAX_TOKENS, CONFIG_MAX_RANGE = 1500, (64, 4096)
CONFIG_OVERLAP_TOKENS, CONFIG_OVERLAP_RANGE = 80, (0, 512)

# --- Fixed values: finished reply states, no-answer phrases -------------------
DONE_STATUSES = ["success", "fallback", "no_answer", "llm_error", "blocked"]
NO_ANSWER_PHRASES = [
    "không đủ nguồn",
    "không có đủ thông tin",
    "không tìm thấy",
    "không thể trả lời",
    "i don't have enough information",
    "i cannot answer",
    "not enough information",
]

# --- Fixed values: headings of a prompt's parts, and what stands for a missing one ---
PROMPT_QUESTION = "CÂU HỎI HIỆN TẠI (ưu tiên tuyệt đối)"
PROMPT_CONTEXT, PROMPT_NO_CONTEXT = "NGỮ CẢNH TRUY XUẤT", "[Không có ngữ cảnh truy xuất]"
PROMPT_HISTORY = "LỊCH SỬ HỘI THOẠI (chỉ để hiểu ngữ cảnh, KHÔNG phải câu hỏi cần trả lời)"
PROMPT_NO_HISTORY = "[Không có lịch sử]"
PROMPT_RULES, PROMPT_NOTES = "YÊU CẦU TRẢ LỜI", "GHI CHÚ BỔ SUNG"

# --- Fixed values: stopwords ---------------------------------------------------
STOPWORDS = [
    "là", "của", "và", "có", "được", "này", "đó", "các", "cho", "với", "tại", "về", "như", "từ",
    "trong", "khi", "để", "theo", "những", "một", "đã", "sẽ", "thì", "mà", "hay", "hoặc", "nên",
    "vì", "do", "bị", "bởi", "ra", "vào", "lên", "xuống", "đang", "rất", "cũng", "không", "còn",
    "nữa", "nào", "gì", "ai", "sao", "bao", "nhiêu",
]

# --- Fixed values: heading words, page header words ----------------------------
HEADING_CAPITALS = "A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ"
HEADING_MAX_CHARS = 120
HEADING_NOT_ENDING = [
    ",", "và", "hoặc", "của", "theo", "để", "trong", "khi", "là", "các", "được",
    "có", "về", "với", "tại", "cho", "từ", "như", "này",
]
PAGE_HEADER_LINE = (
    r"^.{0,150}?(CÔNG TY TNHH [^|\n]{1,80}\|\s*Quy định|Mã tài liệu|Lần ban hành|Ngày hiệu lực).*$"
)
PAGE_HEADER_WORDS = r"CÔNG TY TNHH|Mã tài liệu|Lần ban hành|Ngày hiệu lực"

# --- Fixed values: personal data patterns in order of precedence ----------------
PII_PATTERNS = [
    ("PERSON_NAME",
     r"\b(?:Nguyễn|Trần|Lê|Phạm|Hoàng|Huỳnh|Phan|Vũ|Võ|Đặng|Bùi|Đỗ|Hồ|Ngô|Dương|Lý)"
     r"(?:\s+[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐƠƯ][a-zàáâãèéêìíòóôõùúýăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]+){1,3}\b",
     0.8),
    ("PHONE_NUMBER",
     r"\b(?:\+84|0)(?:3[2-9]|5[6-9]|7[0-9]|8[0-9]|9[0-9])[\s\-]?\d{3}[\s\-]?\d{3}\b", 0.85),
    ("SALARY_AMOUNT", r"\b\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng|vnđ)\b", 0.85),
    ("ADDRESS",
     r"(?:Số\s+\d+[^,\n]{0,30}(?:đường|phố|ngõ|ngách)[^,\n]{0,40}"
     r"|(?:Căn hộ|Phòng)\s+\w+[^,\n]{0,60})", 0.75),
    ("CCCD_CMND", r"\b\d{9}(?:\d{3})?\b", 0.7),
    ("EMAIL_ADDRESS", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.9),
    ("BANK_ACCOUNT", r"\b\d{10,19}\b", 0.5),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.8),
    ("DATE_OF_BIRTH",
     r"\b(?:0[1-9]|[12]\d|3[01])[/\-](?:0[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b", 0.65),
    ("PASSPORT", r"\b[A-Z]\d{7,8}\b", 0.6),
]
DIRECTOR_MASK_TYPES = [
    "SALARY_AMOUNT", "PHONE_NUMBER", "EMAIL_ADDRESS", "CCCD_CMND",
    "BANK_ACCOUNT", "ADDRESS", "DATE_OF_BIRTH",
]
DIRECTOR_REDACTIONS = [
    (r"\b\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng)\b", "[SỐ TIỀN ĐÃ ẨN]"),
    (r"\b(?:\+84|0)(?:3[2-9]|5[6-9]|7[0-9]|8[0-9]|9[0-9])[\s\-]?\d{3}[\s\-]?\d{3}\b", "[SĐT ĐÃ ẨN]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL ĐÃ ẨN]"),
    (r"\b\d{9}(?:\d{3})?\b", "[CCCD ĐÃ ẨN]"),
]

# --- Fixed values: secret keywords -----------------------------------------------
HARD_SECRETS = [
    "api key", "secret key", "private key",
    "mật khẩu hệ thống", "credentials nội bộ",
    "bảng lương",
    "danh sách sa thải", "danh sách nhân viên bị sa thải",
    "danh sách khách hàng vip",
    "kế hoạch mua lại", "kế hoạch sáp nhập",
    "lợi nhuận chưa công bố",
    "thỏa thuận bảo mật", "nda",
    "giá thỏa thuận riêng",
]
SOFT_SECRETS = [
    "doanh thu nội bộ", "ngân sách nội bộ", "chi phí nội bộ",
    "báo cáo tài chính nội bộ", "kế hoạch tài chính",
    "chiến lược nội bộ", "lộ trình sản phẩm", "roadmap nội bộ",
    "kế hoạch mở rộng", "kế hoạch kinh doanh bí mật",
    "thưởng nội bộ", "đánh giá nhân viên nội bộ", "cắt giảm nhân sự",
    "tranh chấp pháp lý", "đang bị kiện", "hợp đồng bảo mật",
    "non-disclosure", "thâu tóm", "m&a",
    "thông tin khách hàng bảo mật", "đối tác chiến lược bí mật",
    "source code nội bộ",
    "dự án bí mật", "dự án chưa ra mắt", "sản phẩm chưa công bố",
    "tính năng chưa phát hành",
]

# --- Fixed values: prompt injection patterns, first match wins --------------------
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"bỏ\s+qua\s+(tất\s+cả\s+)?hướng\s+dẫn",
    r"forget\s+(everything|your\s+instructions?)",
    r"you\s+are\s+now\s+(a\s+)?(?:evil|jailbreak|DAN|unrestricted)",
    r"act\s+as\s+(?:if\s+you\s+(?:have\s+no\s+restrictions?|are\s+jailbroken))",
    r"pretend\s+(you\s+are|to\s+be)\s+(?:an?\s+)?(?:evil|unrestricted|jailbroken)",
    r"dump\s+(all|every|the\s+entire)\s+(data|document|context|prompt|system)",
    r"print\s+(your\s+)?(system\s+)?prompt",
    r"liệt\s+kê\s+toàn\s+bộ\s+(tài\s+liệu|dữ\s+liệu|nội\s+dung)",
    r"show\s+me\s+(all|every)\s+(document|file|secret|hidden)",
    r"</?(system|prompt|instruction|context)>",
    r"\{\{.*?\}\}",
    r"<\|im_start\|>",
]

# --- Fixed values: structured entity patterns (label, pattern, ignore case, group) --
ENTITY_PATTERNS = [
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+", False, 0),
    ("phone", r"\b0\d{2,3}[.\s]?\d{3}[.\s]?\d{3,4}\b", False, 0),
    ("national_id", r"(?:CCCD|CMND|Số CMND/CCCD|Số CMND|Số CCCD)[:\s/]*?(\d{9}|\d{12})", True, 1),
    ("tax_id", r"(?:mã số thuế)[^\d]{0,15}(\d{10,13})", True, 1),
    ("social_insurance", r"(?:số BHXH|số sổ BHXH)[:\s]*?([A-Z]{2}\d{8,12}|\d{8,12})", True, 1),
    ("bank_account", r"(?:tài khoản|TK)[^\d]{0,20}(\d{9,16})", True, 1),
    ("dob", r"(?:ngày sinh|sinh ngày|DOB)[:\s]*?(\d{1,2}/\d{1,2}/\d{2,4})", True, 1),
    ("date_generic", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", False, 0),
    ("money", r"\b[\d.,]+\s?(?:VND|đồng|VNĐ)\b", True, 0),
    ("percentage", r"\b\d{1,3}\s?%", False, 0),
]
FLAGS = ["has_pii", "has_financial", "has_credential", "has_legal", "has_strategic", "has_hr"]
ENTITY_FLAGS = {
    "email": ["has_pii"],
    "phone": ["has_pii"],
    "national_id": ["has_pii", "has_hr"],
    "tax_id": ["has_pii", "has_hr"],
    "social_insurance": ["has_pii", "has_hr"],
    "bank_account": ["has_pii", "has_financial"],
    "dob": ["has_pii", "has_hr"],
    "money": ["has_financial"],
    "percentage": ["has_financial"],
    "date_generic": [],
}
KEYWORD_FLAGS = [
    ("has_credential", r"\b(mật khẩu|password|api[_\s]?key|token|secret|otp)\b"),
    ("has_legal", r"\b(nghị định|thông tư|điều\s+\d+|luật|hợp đồng|quyết định số)\b"),
    ("has_strategic", r"\b(chiến lược|kế hoạch mở rộng|sáp nhập|m&a|định hướng|roadmap)\b"),
]
FLAG_WEIGHTS = {
    "has_credential": 2, "has_pii": 1, "has_hr": 1,
    "has_strategic": 1, "has_financial": 1, "has_legal": 0,
}

# --- Fixed values: sensitivity patterns by level -------------------------------------
LEVEL_PATTERNS = {
    4: [
        r"hồ\s+sơ\s+nhân\s+viên", r"[A-Z]{2,5}-EMP-\d+", r"mức\s+lương\s+cơ\s+bản",
        r"tổng\s+thu\s+nhập", r"lịch\s+sử\s+kỷ\s+luật", r"đánh\s+giá\s+nhân\s+viên",
        r"người\s+liên\s+hệ\s+khẩn\s+cấp", r"bảng\s+lương",
        r"thông\s+tin\s+tài\s+khoản\s+ngân\s+hàng",
        r"\d{1,3}(?:[.,]\d{3})+\s*(?:VND|đồng)", r"số\s+cccd",
        r"địa\s+chỉ\s+thường\s+trú", r"chỗ\s+ở\s+hiện\s+tại",
    ],
    3: [
        r"doanh\s+thu\s+nội\s+bộ", r"ngân\s+sách\s+(?:bộ\s+phận|phòng|dự\s+án)",
        r"kế\s+hoạch\s+kinh\s+doanh", r"báo\s+cáo\s+tài\s+chính\s+nội\s+bộ",
        r"chiến\s+lược\s+(?:nội\s+bộ|công\s+ty)", r"kế\s+hoạch\s+nhân\s+sự",
        r"cắt\s+giảm\s+nhân\s+sự", r"danh\s+sách\s+(?:khách\s+hàng|đối\s+tác)",
    ],
    2: [
        r"nội\s+quy\s+(?:công\s+ty|lao\s+động)", r"quy\s+trình\s+nội\s+bộ", r"biên\s+bản\s+họp",
    ],
}
LEVEL_NAMES = ["Public", "Internal", "Confidential", "Restricted", "TopSecret"]
ROLE_LEVEL_RANKS = {"public": 1, "internal": 2, "confidential": 3, "restricted": 4, "top_secret": 5}
EDIT_ROLES = ["department_manager", "director", "admin_auditor"]
ALL_JOB_ROLES = ["director", "admin_auditor"]

# --- Fixed values: intent keywords in match order, risk weights ------------------------
INTENT_KEYWORDS = [
    ("export", ["xuất", "tải về", "tải xuống", "export", "download", "excel", "csv",
                "báo cáo xuất", "trích xuất toàn bộ"]),
    ("aggregate", ["tổng cộng", "tổng hợp", "bao nhiêu", "thống kê", "đếm", "trung bình",
                   "sum", "count", "aggregate", "thống kê", "tổng số", "bao gồm tất cả"]),
    ("compare", ["so sánh", "khác nhau", "giống nhau", "phân biệt", "compare", "versus", "vs",
                 "hơn hay kém", "khác biệt", "đối chiếu"]),
    ("summarize", ["tóm tắt", "tóm lược", "tổng quan", "overview", "summarize", "summary",
                   "ngắn gọn", "điểm chính", "ý chính", "nội dung chính"]),
]
AMBIGUOUS_QUERY = r"\b(toàn bộ|tất cả|mọi|hết|danh sách|list|all|every)\b"
RISK_KEYWORDS = ["lương", "salary", "khách hàng vip", "mật", "confidential", "bí mật"]

# --- Fixed values: restrictiveness orders, notices, block messages ----------------------
DETAIL_ORDER = {"redact": 4, "anonymize": 3, "generalize": 2, "summarize": 1}
NUMERIC_ORDER = {"hidden": 4, "aggregated": 3, "range_only": 2, "exact": 1}
REDACT_NOTICE = "[Nội dung này đã được ẩn theo chính sách phân quyền.]"
TRANSFORM_NOTICES = {
    "redact": REDACT_NOTICE,
    "anonymize": "[Nội dung đã được ẩn danh hóa theo chính sách phân quyền.]",
    "generalize": "[Nội dung đã được khái quát hóa theo chính sách phân quyền.]",
    "summarize": "[Nội dung đã được tóm tắt theo chính sách phân quyền.]",
}
WATERMARK_SUFFIX = "\n\n[Watermark: nội dung được kiểm soát theo chính sách phân quyền]"
BLOCK_MESSAGES = {
    "PROMPT_INJECTION": "Câu hỏi của bạn có dấu hiệu cố tình can thiệp vào hệ thống. Vui lòng đặt câu hỏi bình thường.",
    "JAILBREAK": "Câu hỏi của bạn vi phạm chính sách sử dụng. Vui lòng thử lại với câu hỏi khác.",
    "HARMFUL_INTENT": "Yêu cầu này không thể được xử lý do vi phạm chính sách an toàn.",
    "DATA_EXFILTRATION": "Không thể thực hiện yêu cầu trích xuất dữ liệu hàng loạt.",
    "OFF_TOPIC": "Câu hỏi này nằm ngoài phạm vi hỗ trợ của hệ thống. Vui lòng hỏi về các tài liệu nội bộ của công ty.",
}
BLOCK_MESSAGE_DEFAULT = "Không thể xử lý yêu cầu này. Vui lòng thử lại với câu hỏi khác."
EMPTY_ANSWER = "Sorry, can't find the source of information."
NO_CONTENT_ANSWER = "Sorry, can find source but not content found."
SUMMARY_HEADER = "[Tóm tắt cuộc trò chuyện trước]\n"
TURN_LABELS = {"user": "Người dùng", "assistant": "Trợ lý"}

# --- Fixed values: settings defaults (JSON text) -----------------------------------------
SETTING_DEFAULTS = [
    ("rag.top_k", "5"),
    ("rag.similarity_threshold", "0.0"),
    ("rag.hybrid_search", "true"),
    ("query_scope_mode", '"full_db"'),
]

# --- Fixed values: metadata keys, first hit wins -------------------------------------------
SECTION_PATH_KEYS = [
    "section_path", "heading_path", "title_path", "headings", "heading", "title",
    "section", "outline", "outline_path", "breadcrumb", "breadcrumbs", "path",
]
PAGE_KEYS = [
    "page_start", "page_end", "page", "page_number", "page_no", "page_idx",
    "pages", "page_numbers",
]
