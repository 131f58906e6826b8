"""Fixed values of the legal-document domain: words, patterns and limits that results depend on."""

# --- Fixed values: document types in the order in which they are looked for ---
DOCUMENT_TYPES = [
    ("hiến pháp", "constitution"), ("hien phap", "constitution"), ("bộ luật", "code"), ("bo luat", "code"), ("luật", "law"), ("luat", "law"),
    ("pháp lệnh", "ordinance"), ("phap lenh", "ordinance"), ("nghị quyết", "resolution"), ("nghi quyet", "resolution"),
    ("nghị định", "decree"), ("nghi dinh", "decree"), ("thông tư", "circular"), ("thong tu", "circular"),
]

# --- Fixed values: the four states of a document ---
IN_FORCE, PARTLY_EXPIRED, EXPIRED, NOT_YET = "Đang có hiệu lực", "Hết hiệu lực một phần", "Hết hiệu lực toàn bộ", "Chưa có hiệu lực"

# --- Fixed values: rank of document types, highest first; others rank 99 ---
TYPE_RANKS = {"Hiến pháp": 1, "Bộ luật": 2, "Luật": 3, "Pháp lệnh": 4, "Lệnh": 5, "Nghị quyết": 6, "Nghị định": 7, "Quyết định": 8, "Thông tư": 9, "Chỉ thị": 10}

# --- Fixed values: words that hint at entities, and verbs that hint at relations ---
ENTITY_HINTS = [
    "bộ", "sở", "ban", "ngành", "ủy ban", "uy ban", "tổng cục", "cục", "chi cục", "đoàn", "hội đồng", "chính phủ", "quốc hội", "đảng", "nhà nước", "trung ương", "địa phương",
    "doanh nghiệp", "công ty", "tập đoàn", "tổng công ty", "tổ chức", "đề án", "dự án", "chương trình", "kế hoạch", "chiến lược", "quỹ",
]
RELATION_HINTS = [
    "sửa đổi", "bổ sung", "thay thế", "bãi bỏ", "hết hiệu lực", "hủy bỏ", "đình chỉ", "đính chính", "giao cho", "giao trách nhiệm", "giao nhiệm vụ", "ủy quyền", "phân công",
    "căn cứ", "áp dụng", "hướng dẫn thi hành", "quy định chi tiết", "ban hành kèm theo", "thực hiện theo", "ngưng hiệu lực", "chấm dứt hiệu lực",
]

# --- Fixed values: keywords before a citation that name the relation, in order of precedence; in the preamble and in the articles of a text ---
PREAMBLE_WORDS = [
    ("GUIDES", ["hướng dẫn thi hành", "quy định chi tiết", "hướng dẫn thực hiện"]),
    ("APPLIES", ["áp dụng", "thực hiện theo", "theo quy định tại", "dẫn chiếu", "chiếu theo"]),
    ("ISSUED_WITH", ["ban hành kèm theo", "ban hành kèm", "đính kèm", "kèm theo"]),
]
RELATION_WORDS = [
    ("REPEALS", ["bãi bỏ", "hết hiệu lực", "hủy bỏ", "đình chỉ", "chấm dứt hiệu lực", "không còn hiệu lực", "bãi bỏ quy định tại", "ngưng hiệu lực", "hết hiệu lực thi hành", "hủy bỏ một phần"]),
    ("REPLACES", ["thay thế", "thay thế cho", "thay thế văn bản", "thay cho", "thay thế quy định tại"]),
    ("AMENDS", ["sửa đổi", "bổ sung", "đính chính", "hiệu chỉnh", "sửa đổi tại", "bổ sung tại", "điều chỉnh", "thay đổi một số", "cập nhật", "sửa đổi nội dung"]),
    ("GUIDES", ["hướng dẫn thi hành", "quy định chi tiết", "hướng dẫn thực hiện", "giải thích", "hướng dẫn", "chi tiết tại", "triển khai", "về việc hướng dẫn", "phổ biến hướng dẫn"]),
    ("APPLIES", ["áp dụng", "thực hiện theo", "áp dụng theo", "tuân thủ theo", "đối chiếu theo", "dẫn chiếu", "chiếu theo", "theo nội dung tại", "theo quy định tại"]),
    ("ISSUED_WITH", ["ban hành kèm theo", "ban hành kèm", "đính kèm", "kèm theo", "tài liệu kèm theo", "văn bản kèm theo", "phụ lục kèm theo", "phụ lục"]),
    ("ASSIGNS", ["giao cho", "giao trách nhiệm", "phân công", "giao nhiệm vụ", "ủy quyền", "trách nhiệm của", "giao đơn vị", "ủy thác", "giao"]),
    ("CORRECTS", ["đính chính lỗi", "sửa lỗi", "đính chính sai sót", "khắc phục sai sót", "đính chính văn bản"]),
]
#: What the words between two citations say that the second did to the first; else `AMENDS`.
PASSIVE_WORDS = [
    ("REPLACES", ["thay thế", "thay cho"]),
    ("REPEALS", ["bãi bỏ", "hết hiệu lực", "hủy bỏ", "đình chỉ", "ngưng hiệu lực", "chấm dứt hiệu lực", "không còn hiệu lực"]),
    ("CORRECTS", ["đính chính", "sửa lỗi", "khắc phục sai sót"]),
]
#: A passive clause between two citations, the start of a preamble's paragraph, the start of the articles (Java syntax).
PASSIVE = (
    r"(?iu)(?:đã\s+)?được\s+"
    r"(?:sửa\s+đổi|bổ\s+sung|thay\s+thế|bãi\s+bỏ|đính\s+chính|hết\s+hiệu\s+lực|hủy\s+bỏ|đình\s+chỉ|ngưng\s+hiệu\s+lực|hiệu\s+chỉnh|điều\s+chỉnh|cập\s+nhật)"
    r"(?:[^,\.]{0,100}?,\s*(?:sửa\s+đổi|bổ\s+sung|đính\s+chính|thay\s+thế|bãi\s+bỏ))?"
    r"[^\n\.]{0,150}?(?:theo|bởi|tại)\s+"
)
PREAMBLE_START = r"(?iu)^\s*(?:căn\s+cứ|-\s*căn\s+cứ|theo\s+(?:quy\s+định|điều|khoản))"
HEADING = r"(?imu)^\s*(?:Điều|Chương|Phần|Mục)\s+[0-9IVXLCDM]+[a-zA-ZĐđ]*[\.:\-]*\s*"
#: Laws that are cited by name, and their numbers.
LAW_NUMBERS = {
    "37 luật có liên quan đến quy hoạch": "35/2018/QH14",
    "luật chứng khoán, luật kế toán, luật kiểm toán độc lập": "56/2024/QH15",
    "hiến pháp nước cộng hòa xã hội chủ nghĩa việt nam": "Hiến pháp 2013",
    "bộ luật dân sự": "91/2015/QH13",
    "bộ luật hình sự": "100/2015/QH13",
    "bộ luật lao động": "45/2019/QH14",
    "bộ luật tố tụng hình sự": "101/2015/QH13",
    "bộ luật tố tụng dân sự": "92/2015/QH13",
    "luật bầu cử đại biểu quốc hội và đại biểu hội đồng nhân dân": "85/2015/QH13",
    "luật tổ chức chính quyền địa phương": "77/2015/QH13",
    "luật tổ chức chính phủ": "76/2015/QH13",
    "luật ban hành văn bản quy phạm pháp luật": "80/2015/QH13",
    "luật thi đua, khen thưởng": "06/2022/QH15",
    "luật ngân sách nhà nước": "83/2015/QH13",
    "luật quản lý thuế": "38/2019/QH14",
    "luật thuế giá trị gia tăng": "48/2024/QH15",
    "luật thuế thu nhập cá nhân": "04/2007/QH12",
    "luật thuế xuất khẩu, thuế nhập khẩu": "107/2016/QH13",
    "luật kế toán": "88/2015/QH13",
    "luật kiểm toán độc lập": "67/2011/QH12",
    "luật quản lý, sử dụng tài sản công": "15/2017/QH14",
    "luật dự trữ quốc gia": "22/2012/QH13",
    "luật hải quan": "54/2014/QH13",
    "luật đầu tư theo phương thức đối tác công tư": "64/2020/QH14",
    "luật đầu tư công": "39/2019/QH14",
    "luật đầu tư": "61/2020/QH14",
    "luật doanh nghiệp": "59/2020/QH14",
    "luật đấu thầu": "22/2023/QH15",
    "luật chứng khoán": "54/2019/QH14",
    "luật các tổ chức tín dụng": "32/2024/QH15",
    "luật đất đai": "31/2024/QH15",
    "luật nhà ở": "27/2023/QH15",
    "luật kinh doanh bất động sản": "29/2023/QH15",
    "luật bảo hiểm xã hội": "41/2024/QH15",
    "luật giáo dục": "43/2019/QH14",
    "luật khám bệnh, chữa bệnh": "15/2023/QH15",
    "luật xử lý vi phạm hành chính": "15/2012/QH13",
    "luật xuất bản": "19/2012/QH13",
    "luật báo chí": "103/2016/QH13",
    "luật an toàn, vệ sinh lao động": "84/2015/QH13",
    "luật dược": "105/2016/QH13",
    "luật phòng, chống bệnh truyền nhiễm": "03/2007/QH12",
    "luật bảo hiểm y tế": "25/2008/QH12",
    "luật hiến, lấy, ghép mô, bộ phận cơ thể người và hiến, lấy xác": "73/2006/QH11",
}
#: Citations by number and by name (Java syntax); strict numbers have a year.
CITED_STRICT = r"\b\d+[\-\/](?:20\d{2}|19\d{2})[\-\/][A-Z\u0110][A-Z0-9\u0110a-z\u0111\-\/]*\b"
CITED_ANY = r"\b\d+[\/\-](?:20\d{2}|19\d{2})[\/\-][A-ZĐ][A-Z0-9Đa-zđ\-\/]*\b|\b\d+[\/\-][A-ZĐ][A-Z0-9Đa-zđ\-\/]*\b"
CITED_LAW = (
    r"\b(?:{names})(?:\s+năm\s+\d{{4}})?|"
    r"\b(?:Hiến pháp|Bộ luật|Luật)[\w\s\,\.\-\u00C0-\u1EF9]*?(?:\s+năm\s+\d{{4}})|\bHiến pháp(?:\s+năm\s+\d{{4}})?"
)
FIRST_ARTICLE, FIRST_CLAUSE = r"(?iu)((?:Điều|Chương|Phần|Mục)\s+[0-9A-ZĐđ]+)", r"(?iu)(Khoản\s+\d+)"
DEFAULT_RELATION = "BASED_ON"
LOOK_BACK = 200

# --- Fixed values: relation names ---
DOC_RELATIONS = ["BASED_ON", "AMENDS", "REPEALS", "REPLACES", "GUIDES", "APPLIES_TO", "ISSUED_WITH", "ASSIGNS", "CORRECTS", "AMENDED_BY", "REPEALED_BY", "REPLACED_BY", "GUIDED_BY", "REFERENCED_BY"]
BLACKLIST = [
    "IS", "HAS", "DEADLINE", "EFFECTIVE_FROM", "HAS_MINIMUM_SIZE", "PUBLISHED_ON", "STARTS_AT", "ENDS_AT", "IS_EQUAL_TO", "NOT_EQUAL_TO", "MUST_NOT_BE_HIGHER_THAN", "MUST_NOT_BE_LOWER_THAN",
    "OCCURS_AT", "OCCURS_EVERY", "EXPIRES_ON", "MEETS_EVERY", "UPDATED_EVERY", "EXECUTED_AT", "EXECUTED_ON",
]
ENTITY_TYPES = ["Organization", "Person", "Location", "Document", "LegalArticle", "Procedure", "Condition", "Fee", "Penalty", "Timeframe", "Role", "Concept"]
ENTITY_TYPE_ALIASES = {"Article": "LegalArticle", "Authority": "Organization", "Institution": "Organization", "Signer": "Person", "PersonRole": "Person"}
VERB_ROOTS = {
    "ISSUE": "ISSUED_BY", "SIGN": "SIGNED_BY", "APPROV": "APPROVED_BY", "PUBLISH": "PUBLISHED_BY", "CREAT": "CREATED_BY", "ESTABLISH": "ESTABLISHED_BY", "IMPLEMENT": "IMPLEMENTED_BY",
    "ENFORC": "ENFORCED_BY", "APPLY": "APPLIED_BY", "APPLI": "APPLIED_BY", "EXECUT": "EXECUTED_BY", "PERFORM": "IMPLEMENTED_BY", "CARRY": "IMPLEMENTED_BY", "MANAG": "MANAGED_BY",
    "GOVERN": "MANAGED_BY", "SUPERVIS": "MANAGED_BY", "DIRECT": "MANAGED_BY", "REGULAT": "REGULATED_BY", "COORDINAT": "COORDINATED_BY", "TRANSFER": "TRANSFERRED_TO",
    "SUBMIT": "SUBMITTED_TO", "DELEGAT": "DELEGATED_TO", "ASSIGN": "ASSIGNED_TO", "REPORT": "REPORTED_TO", "NOTIF": "NOTIFIED_TO", "INFORM": "NOTIFIED_TO", "PERMIT": "PERMITTED_TO",
    "PROHIBIT": "PROHIBITED_FROM", "EXEMPT": "EXEMPT_FROM", "ENTITL": "ENTITLED_TO", "REQUIR": "REQUIRED_FOR", "AFFECT": "AFFECTED_BY", "DEFIN": "DEFINED_IN", "CLASSIF": "CLASSIFIED_AS",
    "BELONG": "BELONGS_TO", "FUND": "FUNDED_BY", "PAY": "PAID_TO", "COLLECT": "COLLECTED_BY", "REPLAC": "REPLACED_BY", "AMEND": "AMENDED_BY", "REPEAL": "REPEALED_BY",
    "REFERENC": "REFERENCED_BY", "RELAT": "RELATED_TO",
}
#: Relation names between entities.
NODE_RELATIONS = [
    "ISSUED_BY", "SIGNED_BY", "APPROVED_BY", "PUBLISHED_BY", "CREATED_BY", "ESTABLISHED_BY",
    "IMPLEMENTED_BY", "ENFORCED_BY", "APPLIED_BY", "EXECUTED_BY",
    "MANAGED_BY", "REGULATED_BY", "COORDINATED_BY",
    "TRANSFERRED_TO", "TRANSFERRED_FROM", "SUBMITTED_TO", "DELEGATED_TO", "ASSIGNED_TO", "ASSIGNED_BY",
    "REPORTED_TO", "NOTIFIED_TO",
    "PERMITTED_TO", "PROHIBITED_FROM", "EXEMPT_FROM", "ENTITLED_TO",
    "REQUIRED_FOR", "REQUIRED_BY", "COMPLIES_WITH", "AFFECTED_BY",
    "DEFINED_IN", "CLASSIFIED_AS", "BELONGS_TO", "PART_OF", "LOCATED_IN", "MEMBER_OF",
    "FUNDED_BY", "PAID_TO", "PAID_BY", "COLLECTED_BY",
    "REPLACED_BY", "AMENDED_BY", "REPEALED_BY", "REFERENCED_BY", "BASED_ON",
    "APPLIES_TO", "RELATED_TO",
]
#: Names that stand for another before anything else is tried.
CROSS_NAMES = {
    "UPDATED_BY": "AMENDED_BY", "UPDATES": "AMENDED_BY", "UPDATED_EVERY": "AMENDED_BY",
    "MODIFIED_BY": "AMENDED_BY", "MODIFIED_VIA": "AMENDED_BY",
    "CORRECTED_BY": "AMENDED_BY", "EXTENDED_BY": "AMENDED_BY", "EXTENDS": "AMENDED_BY",
    "MONITORED_BY": "REVIEWED_BY", "MONITORS": "REVIEWED_BY",
    "INSPECTED_BY": "REVIEWED_BY", "INSPECTS": "REVIEWED_BY",
    "INVESTIGATED_BY": "REVIEWED_BY", "INVESTIGATES": "REVIEWED_BY",
    "VERIFIED_BY": "REVIEWED_BY",
    "EVALUATED_BY": "ASSESSED_BY", "EVALUATES": "ASSESSED_BY", "TESTED_BY": "ASSESSED_BY",
    "ASSIGNED_TO": "ALLOCATED_TO", "ASSIGNED_BY": "ALLOCATED_BY",
    "DELIVERED_TO": "PROVIDED_TO", "DELIVERS_TO": "PROVIDED_TO",
    "TRANSMITTED_TO": "PROVIDED_TO", "TRANSMITS_DATA_TO": "PROVIDED_TO",
    "TRANSMITTED_BY": "PROVIDED_BY", "TRANSMITTED_VIA": "PROVIDED_BY",
    "PROVIDED_WITH": "PROVIDED_BY",
    "PRODUCED_BY": "CREATED_BY", "PRODUCES": "CREATED_BY",
    "PRODUCED_IN": "CREATED_BY", "PRODUCED_WITH": "CREATED_BY",
    "GENERATES": "CREATED_BY", "CONSTRUCTED_BY": "CREATED_BY",
    "REQUESTS_ACTION_FROM": "REQUESTED_BY", "REQUESTS_INFO_FROM": "REQUESTED_BY",
    "REQUESTED_FROM": "REQUESTED_BY",
    "ASSISTED_BY": "SUPPORTED_BY", "ASSISTS": "SUPPORTED_BY",
    "CONFORMS_TO": "COMPLIES_WITH", "MUST_MEET": "COMPLIES_WITH",
    "IS_EQUAL_TO": "RELATED_TO", "NOT_EQUAL_TO": "RELATED_TO",
    "SELF_REFERENCE": "RELATED_TO", "LACKS": "RELATED_TO",
    "LACKS_SKILL": "RELATED_TO", "LACKS_KNOWLEDGE": "RELATED_TO",
    "MUST_NOT_MISLEAD": "RELATED_TO", "PROVES": "RELATED_TO",
    "PERFORMS_IF_DISAGREES": "IMPLEMENTED_BY",
    "USES_FOR": "USED_FOR", "USED_WITH": "USED_IN",
}
#: Synonyms that are looked up after the names above. The forms that the verb roots give anyway (ISSUES, SIGNED,
#: TRANSFERS_TO, ...) come from that rule, and those that the names above replace first can't be reached; neither is listed.
RELATION_ALIASES = {
    "ACCEPTS": "ACCEPTED_BY", "CONFIRMS": "CONFIRMED_BY", "ACKNOWLEDGES": "ACKNOWLEDGED_BY",
    "CARRIED_OUT_BY": "IMPLEMENTED_BY", "DIRECTS_IMPLEMENTATION_OF": "IMPLEMENTED_BY", "GUIDES_IMPLEMENTATION_OF": "IMPLEMENTED_BY",
    "LEADS": "MANAGED_BY", "LEAD_BY": "MANAGED_BY", "OPERATES_UNDER": "MANAGED_BY", "SUBORDINATE_TO": "MANAGED_BY",
    "IS_RESPONSIBLE_FOR": "MANAGED_BY", "RESPONSIBLE_FOR": "MANAGED_BY", "ACCOUNTABLE_TO": "MANAGED_BY",
    "IS_HIGHEST_AUTHORITY_OF": "MANAGED_BY", "CHAIRMANED_BY": "MANAGED_BY", "ASSESSES": "MANAGED_BY",
    "DECIDES": "DECIDED_BY", "DETERMINES": "DETERMINED_BY", "ORGANIZES": "ORGANIZED_BY", "INITIATES": "INITIATED_BY",
    "GUIDES": "GUIDED_BY", "HANDLES": "HANDLED_BY",
    "CONTRACTS_WITH": "COOPERATES_WITH", "ORGANIZES_WITH": "ORGANIZED_WITH", "PARTICIPATES_IN": "PARTICIPATED_BY", "CONSULTED_WITH": "CONSULTED_BY",
    "TRANSPORTS": "TRANSFERRED_TO", "DELIVERS": "TRANSFERRED_TO",
    "RETURNED_TO": "TRANSFERRED_TO", "RETURNED_BY": "TRANSFERRED_TO",
    "APPOINTS": "APPOINTED_BY", "EMPLOYS": "EMPLOYED_BY", "IMPORTS": "IMPORTED_BY", "PROPOSED_TO": "SUBMITTED_TO",
    "PROVIDES_INFO_TO": "NOTIFIED_TO", "PUBLISHES_INFO_TO": "NOTIFIED_TO", "RECEIVES_INFO_FROM": "NOTIFIED_TO",
    "RECEIVES": "RECEIVED_BY", "RECEIVED_FROM": "RECEIVED_BY",
    "CAN_PERFORM": "PERMITTED_TO", "PREVENTED_BY": "PROHIBITED_FROM", "MUST_NOT_PERFORM": "PROHIBITED_FROM",
    "MUST_PROTECT": "PROTECTED_BY", "PROTECTS": "PROTECTED_BY", "EXCLUDED_FROM": "EXEMPT_FROM",
    "PRIORITY_FOR": "ENTITLED_TO", "PRIORITY_OVER": "ENTITLED_TO", "HAS_PRIORITY_ACCESS_TO": "ENTITLED_TO",
    "MUST_COMPLY_WITH": "COMPLIES_WITH", "CONDITIONED_ON": "COMPLIES_WITH", "ENSURES_COMPLIANCE_WITH": "COMPLIES_WITH", "COMPLIES": "COMPLIES_WITH",
    "ENSURES": "ENSURED_BY", "SUBJECTED_TO": "AFFECTED_BY",
    "MARKED_WITH": "CLASSIFIED_AS", "NAMED_AFTER": "CLASSIFIED_AS", "IS_LEGAL_REPRESENTATIVE_OF": "BELONGS_TO",
    "CONTAINED_IN": "PART_OF", "CONTAINS": "PART_OF", "INCLUDED_IN": "PART_OF", "INCLUDES": "PART_OF", "ATTACHED_TO": "PART_OF",
    "WORKS_FOR": "BELONGS_TO", "WORKS_IN": "BELONGS_TO", "REPRESENTS": "REPRESENTED_BY",
    "PAYS": "PAID_TO", "PAID_FOR": "PAID_TO", "DEDUCTED_FROM": "PAID_TO", "COMPENSATED_BY": "PAID_BY", "DEPOSITED_TO": "PAID_TO", "PURCHASED_FROM": "PAID_BY",
    "ALLOCATED_BY": "FUNDED_BY", "ALLOCATED_FOR": "FUNDED_BY", "ALLOCATED_FROM": "FUNDED_BY", "ALLOCATED_TO": "FUNDED_BY", "ALLOCATED_VIA": "FUNDED_BY", "ALLOCATES": "FUNDED_BY",
    "REMOVED_FROM": "REPEALED_BY", "REFERS_TO": "REFERENCED_BY", "REFERRED_BY": "REFERENCED_BY",
    "ISSUED_FOR": "APPLIES_TO", "DESIGNED_FOR": "APPLIES_TO", "ORGANIZED_FOR": "APPLIES_TO", "PERMITTED_BY": "APPLIES_TO", "APPLIES": "APPLIES_TO",
    "CONNECTED_TO": "RELATED_TO", "SYNCHRONIZED_WITH": "RELATED_TO", "SUPPLEMENTED_BY": "RELATED_TO", "COVERS": "RELATED_TO", "COVERED_BY": "RELATED_TO",
    "LEASED_BY": "RELATED_TO", "ASSUMES": "RELATED_TO", "SEPARATED_FROM": "RELATED_TO", "STORED_AT": "LOCATED_IN",
    "GENERATED_BY": "CREATED_BY", "REVOKES": "REPEALED_BY", "REVOKED_BY": "REPEALED_BY", "SUSPENDED_BY": "REPEALED_BY", "TERMINATED_BY": "REPEALED_BY",
    "SUPPORTED_BY": "IMPLEMENTED_BY", "SUPPORTS": "IMPLEMENTED_BY",
    "MAINTAINED_BY": "IMPLEMENTED_BY", "MAINTAINS": "IMPLEMENTED_BY", "SERVICED_BY": "IMPLEMENTED_BY", "SERVICES": "IMPLEMENTED_BY",
    "PROCESSED_BY": "IMPLEMENTED_BY", "PROCESSED_IN": "IMPLEMENTED_BY",
    "TEACHES": "EDUCATED_BY", "TRAINING_PROVIDED_BY": "EDUCATED_BY", "TRIGGERS": "TRIGGERED_BY", "USES": "USED_BY",
    "PROVIDES": "PROVIDED_BY", "PROVIDES_TO": "PROVIDED_TO", "OPENS": "OPENED_BY", "DEVELOPS": "DEVELOPED_BY",
    "PREPARES": "PREPARED_BY", "PREPARED_WITH": "PREPARED_BY", "AWARDS": "AWARDED_BY", "AWARDED_WITH": "AWARDED_TO", "CALCULATED_FROM": "CALCULATED_BY",
    "ASSESSED_BY": "MANAGED_BY", "REVIEWED_BY": "MANAGED_BY", "REVIEWS": "MANAGED_BY", "ANALYZED_BY": "MANAGED_BY", "AUDITED_BY": "MANAGED_BY",
    "PENALIZED_BY": "AFFECTED_BY", "CONFISCATED_BY": "AFFECTED_BY", "DETAINED_BY": "AFFECTED_BY", "EXPROPRIATED_BY": "AFFECTED_BY", "EXPROPRIATES": "AFFECTED_BY",
    "PROPOSES": "PROPOSED_BY", "ELECTS": "ELECTED_BY",
}
#: Synonyms of edge types in a graph store.
EDGE_ALIASES = {
    "ISSUED": "ISSUED_BY", "SIGNED": "SIGNED_BY", "APPLIES": "APPLIES_TO", "SUPERVISED_BY": "MANAGED_BY",
    "ACCOUNTABLE_TO": "MANAGED_BY", "RESPONSIBLE_FOR": "MANAGED_BY", "IMPLEMENTED_BY": "MANAGED_BY", "ASSIGNS": "ASSIGNED_BY",
}
COREFERENCE = ["cơ quan", "tổ chức", "cá nhân", "đối tượng", "người", "văn bản", "điều", "khoản", "chương", "phần", "mục"]
COREFERENCE_ENDS = [" này", " đó", " nêu trên", " dưới đây", " sau đây"]

# --- Fixed values: question intents: keywords (the first intent that matches counts), labels and relations that an answer is sought among ---
INTENTS = [
    ("authority", ["ban hành", "ký", "phê duyệt", "cơ quan ban hành", "ai ký", "ai ban hành", "thẩm quyền", "được ký bởi", "được ban hành"], ["Organization", "Person"], ["ISSUED_BY", "SIGNED_BY", "APPROVED_BY", "CREATED_BY"]),
    ("penalty", ["xử phạt", "mức phạt", "vi phạm", "hình thức xử lý", "phạt tiền", "bị phạt"], ["Penalty"], ["APPLIES_TO", "AFFECTED_BY"]),
    ("fee", ["lệ phí", "phí", "chi phí", "mức phí", "tiền", "thu phí", "nộp phí"], ["Fee"], ["COLLECTED_BY", "PAID_TO", "APPLIES_TO"]),
    ("procedure", ["quy trình", "thủ tục", "cấp phép", "đăng ký", "nộp hồ sơ", "hồ sơ", "các bước", "làm thế nào để"], ["Procedure"], ["IMPLEMENTED_BY", "REQUIRED_FOR", "APPLIES_TO"]),
    ("condition", ["điều kiện", "tiêu chuẩn", "yêu cầu", "đủ điều kiện", "tiêu chí"], ["Condition"], ["REQUIRED_FOR", "REQUIRED_BY", "COMPLIES_WITH"]),
    ("timeframe", ["thời hạn", "thời gian", "bao nhiêu ngày", "bao lâu", "trong vòng", "hạn nộp", "hạn chót", "deadline"], ["Timeframe"], ["APPLIES_TO", "REQUIRED_FOR"]),
    ("management", ["quản lý", "giám sát", "điều phối", "cơ quan quản lý", "chịu trách nhiệm"], ["Organization"], ["MANAGED_BY", "REGULATED_BY", "COORDINATED_BY"]),
]

# --- Fixed values: limits of the structure scanner ---
CLAUSE_LIMIT, TEXT_LIMIT, TABLE_ROWS, TABLE_LIMIT, LEAST_LETTERS, LEAST_CELLS, TITLE_CUT, EMBED_CUT = 1500, 2000, 15, 2500, 30, 15, 100, 80

# --- Fixed values: patterns of numbers, citations and dates (Java syntax) ---
NUMBER_WITH_YEAR = r"(?iu)(?:số\s*)?(\d+/\d+(?:/[A-Z0-9Đ\-]+)?)"
NUMBER_SHORT = r"(?iu)(\d+/[A-Z0-9Đ\-]+)"
NUMBER_HINT = r"(?iuU)\b\d+[/\-](?:20\d{2}|19\d{2})[/\-][A-ZĐ][A-Z0-9Đ\-/]+\b|\b\d+[/\-][A-ZĐ][A-Z0-9Đ\-/]{2,}\b"
BASIS_REFERENCE = r"(?iu)(Hiến pháp|Bộ luật|Luật|Nghị quyết|Pháp lệnh|Nghị định|Thông tư)(?U)\b([^.;\n]*)"
EFFECTIVE_DAY = r"(?iu)có\s+hiệu\s+lực\s+(?:từ|kể\s+từ)\s+ngày\s+(\d{1,2})[/\- ](\d{1,2})[/\- ](\d{4})"
EFFECTIVE_FROM_SIGNING = (
    r"(?iu)("
    r"có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+)?từ\s+ngày\s+ký|"
    r"chịu\s+trách\s+nhiệm\s+thi\s+hành\s+(?:quyết\s+định|nghị\s+định|thông\s+tư|văn\s+bản)\s+này"
    r")"
)
SELF_REFERENCE = r"(?iu)(luật|nghị định|thông tư|quyết định|nghị quyết|văn bản)\s+này"
LEGAL_KEYWORDS = "luật|nghị định|thông tư|hiến pháp|quyết định|chỉ thị"
ORGANISATION_START = "^(bộ |sở |tổng công ty|tập đoàn|chính phủ|doanh nghiệp|ủy ban|thanh tra)"
GREETINGS = ["xin chào", "chào", "chào bạn", "hello", "hi", "cảm ơn", "cám ơn", "thanks"]
