"""Words that carry no topic, in natural order."""

# English function words, and Vietnamese ones without marks.
STOP_WORDS = [
    "a", "about", "after", "all", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "had", "has", "have", "he", "her", "his", "in", "into", "is", "it", "its", "more", "new",
    "not", "of", "on", "or", "over", "says", "she", "that", "the", "their", "they", "this", "to", "was", "were", "what", "when", "which", "who", "will", "with",
    "cac", "cho", "co", "cua", "da", "dang", "duoc", "khi", "khong", "la", "mot", "nay", "nhung", "sau", "se", "tai", "the", "theo", "trong", "tu", "va", "ve", "voi",
]

# Outcomes of event resolution, reasons of unknown lineage, and classes of provider errors, as users filter by them.
RESOLVER_PATHS = [
    "time_window", "headline", "rare_token", "person", "bigram_entity", "num_entity", "cross_lingual", "distinctive_claim", "semantic_strong", "semantic_xlang", "semantic_anchored", "semantic_facet", "entity", "generic_claim",
    "semantic_ambiguous", "entity_blocked", "no_path",
]
LINEAGE_REASONS = ["no_evidence", "dangling_attribution", "possible_translation", "conflicting_figures", "conflicting_similarity"]
ERROR_CLASSES = ["unauthorized", "rate_limit", "invalid_symbol", "api_error", "empty", "unexpected_schema"]

# Fixed value: letters that tell Vietnamese from English.
VIETNAMESE_LETTERS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"

# Patterns over normalised Vietnamese text of what is noise, and of what is of public interest all the same.
NOISE = (
    r"nuoc nao la|cau do|trac nghiem|trong \d+ giay|tung uu dai|khuyen mai|giam gia|voucher|lo dien|chuyen tinh|hon nhan|danh ghen|ngoai tinh|trom cap|chuyen phong the|lo anh|tu vi|boi toan|con giap|van han|phong thuy|meo vat|luoc ga|nau an|"
    r"cong thuc|am thuc|quan an|banh mi|banh cuon|meo lam dep|giam can|duong da|va cham giao thong|xe may va cham|tai nan giao thong|xe khach|xe tai lat|tong xe|danh nhau|trom cho|cuop giat|nhay cau|duoi nuoc|nuoc cuon|mat tich|chet duoi|thi the|"
    r"xac chet|tu tu|chay nha|hoa hoan|boc hoa|chay quan|chay xuong|chay rung|chay cho|chay chung cu|mua lon|sam set|ngap ung|trieu cuong|giong loc|loc xoay|mu bao hiem|danh ban|ngo doc|thuc pham|thuc an|nhap vien|tam giam|khoi to|bat giu|"
    r"trieu tap|phat tien|linh an|showbiz|sao viet|hoa hau|a hau|nguoi mau|dien vien|ca si|scandal|lo clip|hen ho|ly hon|chia tay|dam cuoi|uong nuoc|dau lung|ung thu vi|xet nghiem|bai thuoc|con vat la|bat duoc tran|ca la|ran doc|giet nguoi|"
    r"dung dao|dung dien|mau thuan ban nha|oc huong|chet bat thuong|xe volvo|lo luy ke"
)
PUBLIC_INTEREST = (
    r"gia (thuc pham|dien|xang|gao)|an toan thuc pham|thu hoi (san pham|thuc pham)|canh bao (bao|lu|lu quet|thien tai)|so tan|bao hiem y te|hoc phi|luong toi thieu|tro cap|that nghiep|chi phi sinh hoat|lam phat|dich benh|ngap lut dien rong"
)

# Magnitudes and currencies that a claim's text or unit names, the first that matches holds; rates are rough.
MAGNITUDES = [
    (r"(tỷ|tỉ|nghìn tỷ)(?=[^a-zà-ỹ]|$)|\bty_|\b[a-z0-9_]+_bn\b|\bbillion\b|\bbn\b", 1e9),
    (r"(triệu)(?=[^a-zà-ỹ]|$)|\btrieu_|\b[a-z0-9_]+_mn\b|\bmillion\b|\bmn\b", 1e6),
    (r"(nghìn)(?=[^a-zà-ỹ]|$)|\bthousand\b", 1e3),
]
CURRENCIES = [
    (r"[a-z_]*vnđ(?=_bn\b|\b)|[a-z_]*vnd(?=_bn\b|\b)|đồng", 1 / 25000),
    (r"[a-z_]*euro(?=_bn\b|\b)|[a-z_]*eur(?=_bn\b|\b)|€", 1.08),
    (r"[a-z_]*yuan(?=_bn\b|\b)|[a-z_]*cny(?=_bn\b|\b)|nhân dân tệ", 0.14),
    (r"[a-z_]*jpy(?=_bn\b|\b)|yên", 0.0067),
    (r"[a-z_]*gbp(?=_bn\b|\b)|£", 1.27),
    (r"[a-z_]*usd(?=_bn\b|\b)|[a-z_]*us\$|\$|đô la", 1.0),
]

# Fixed value: what makes a claim that is no number peripheral.
PERIPHERAL = (
    r"(ăn (trưa|tối|sáng)|tiệc\b|chiêu đãi|trang phục|đeo găng|găng tay|thảm đỏ|bắt tay|lễ đón|phu nhân|tông màu|tặng hoa|chụp ảnh|sân bay tân sơn nhất|nội các|hội nghị ban chỉ đạo|khai mạc|bế mạc|dự lễ|"
    r"lunch|dinner|banquet|outfit|handshake|red carpet|photo op|welcoming ceremony|gala|first lady|spouse|wearing|wore)"
)
