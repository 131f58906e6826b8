"""Structure of legal texts: chapters, articles, clauses, points, tables and appendices as citable chunks.

Lines are classified by anchored patterns; a small state per document
gathers them into sections and gives a chunk whenever a limit or a new unit
closes one. A document is one row, so nothing is shuffled; batches cross to
Python once, by Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canonry.functions import vocabulary as V
from canonry.functions.arrow_text import slices

# --- Fixed values: patterns of structural lines ---
_FLAGS = re.IGNORECASE
CHAPTER = re.compile(r"(Chương|Phần)(?:\s+thứ)?\s+([a-zA-Z0-9]+)\b\s*[.:\-]?\s*(.*)", _FLAGS)
ARTICLE = re.compile(r"(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)", _FLAGS)
CLAUSES = [re.compile(p, _FLAGS) for p in (r"(Khoản\s+\d+[.:\-]?)\s*(.*)", r"(\d+(?:\.\d+)*[.)])\s*(.*)", r"(\(\d+\))\s*(.*)", r"([-+•])\s+(.*)")]
POINT = re.compile(r"([a-zđ]\s*[).])\s*(.*)", _FLAGS)
LEVEL_1 = re.compile(r"([IVXLCDM]+|[A-Z])\s*[.:\-]\s*(.*)", _FLAGS)
LEVEL_2 = re.compile(r"(\d+)\s*[.:\-]\s*(.*)")
LEVEL_3 = re.compile(r"(\d+(?:\.\d+)+)\s*[.:\-]?\s*(.*)")
PART = re.compile(r"(phần|tập|bài)\s+([ivxlcdm0-9]+)\s*[.:\-–—]?\s*(.*)", _FLAGS)
APPENDIX = re.compile(
    r"(?im)^\s*("
    r"(?:PHỤ\s+LỤC|PHU\s+LUC)(?:\s+(?:SỐ\s+)?(?:[IVXLCDM]+|\d+)|[A-Z])?(?:\s*[\:\-\.]|\s+BAN\s+HÀNH|\s+KÈM\s+THEO)?|"
    r"(?:MẪU|MẪU\s+SỐ|BIỂU\s+MẪU)\s*[A-Za-z0-9\.\-\/]*(?:\s*[\:\-\.]|\s+BAN\s+HÀNH|\s+KÈM\s+THEO)?|"
    r"DANH\s+MỤC(?:\s+(?:CHI\s+TIẾT|KÈM\s+THEO|CÁC|DỰ\s+ÁN|TÀI\s+SẢN|VẬT\s+TƯ|HÀNG\s+HÓA|QUỐC\s+GIA|MÃ))?"
    r")\b.*$"
)
REGULATION = re.compile(
    r"(?im)^\s*(QUY ĐỊNH|QUY CHẾ|QUY CHUẨN|QCVN|TIÊU CHUẨN|TCVN|PHƯƠNG ÁN|ĐIỀU LỆ|CHƯƠNG TRÌNH|HƯỚNG DẪN|NỘI QUY|KẾ HOẠCH|CHIẾN LƯỢC|ĐỀ ÁN|DỰ ÁN)\b(?!\s*CHUNG\b).*$"
)
STANDARD = re.compile(r"(QUY CHUẨN|QCVN|TIÊU CHUẨN|TCVN)", re.IGNORECASE)
FOOTER = re.compile(
    r"(?i)^\s*(nơi\s+nhận|kính\s+gửi)[\:\.]?|"
    r"^\s*(TM\.|KT\.|Q\.|TL\.|TUQ\.)?\s*"
    r"("
    r"CHÍNH\s+PHỦ|UBND|ỦY\s+BAN\s+NHÂN\s+DÂN|"
    r"BỘ\s+TRƯỞNG|CHỦ\s+TỊCH|THỨ\s+TRƯỞNG|GIÁM\s+ĐỐC|TỔNG\s+GIÁM\s+ĐỐC|"
    r"CỤC\s+TRƯỞNG|TỔNG\s+CỤC\s+TRƯỞNG|CHÁNH\s+VĂN\s+PHÒNG|"
    r"CHÁNH\s+ÁN|VIỆN\s+TRƯỞNG|TỔNG\s+KIỂM\s+TOÁN|CHỦ\s+NHIỆM|TỔNG\s+BÍ\s+THƯ"
    r")\b"
)
MOTTO, MOTTO_LINES = ("ĐỘC LẬP", "TỰ DO"), 50
INTRODUCTION, SIGNATURE, TABLE_LABEL, CONTINUED = "Lời dẫn", "Phần Nơi nhận và Chữ ký", "Dữ liệu Bảng biểu", "(tiếp theo)"


def one_line(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Clause:
    """A clause with its points."""

    ref: str
    text: str
    points: list[str] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.text) + sum(map(len, self.points))

    @property
    def base(self) -> str:
        return self.ref.replace(f" {CONTINUED}", "")

    def resumed(self, text: str, as_point: bool) -> Clause:
        """The clause that continues this one in the next chunk."""
        head = f"[{self.base} tiếp theo]"
        return Clause(f"{self.base} {CONTINUED}", head if as_point else f"{head}\n{text}", [text] if as_point else [])


def grouped(refs: list[str]) -> str:
    """References under one heading: clauses 1. and 2. as `Khoản 1, 2.`, points a) and b) as `Điểm a, b)`."""
    refs = [r.strip() for r in refs if r.strip() not in ("-", "+", "•", "")]
    if not refs:
        return ""
    for word in ("Khoản", "Điểm"):
        if refs[0].lower().startswith(word.lower() + " "):
            return f"{word} " + ", ".join(r.split(" ", 1)[1] if r.lower().startswith(word.lower()) and " " in r else r for r in refs)
    for word, left, right in (("Điểm", "", ")"), ("Khoản", "", "."), ("Khoản", "(", ")")):
        first = refs[0]
        inner = first[len(left) : len(first) - 1]
        if first.startswith(left) and first.endswith(right) and inner and not set(inner) & set("()" if right == ")" else "."):
            return f"{word} {left}" + ", ".join(r.removeprefix(left).rstrip(right) for r in refs) + right
    return ", ".join(refs)


@dataclass
class Chunk:
    """A chunk before the document's fields are added."""

    kind: str
    chapter: str
    article: str
    clause: str
    breadcrumb: str
    content: str
    appendix: bool


class Scanner:
    """State of one document between its lines."""

    def __init__(self) -> None:
        self.out: list[Chunk] = []
        self.chapter = self.article = ""
        self.lead: list[str] = []
        self.closed: list[Clause] = []
        self.open: Clause | None = None
        self.appendix = False
        self.header: list[str] = []
        self.rows: list[str] = []
        self.table = False

    # --- giving chunks ---
    def give(self, clauses: list[Clause]) -> None:
        parts = [self.article] if self.article and not self.article.isupper() else []
        parts += ["\n".join(self.lead)] if self.lead else []
        for c in clauses:
            parts += [c.text, *c.points]
        content = "\n".join(parts).strip()
        needed = self.article in (INTRODUCTION, SIGNATURE)
        if not needed and (sum(ch.isalpha() for ch in content) < V.LEAST_LETTERS or (not self.article and not clauses and content.isupper())):
            return
        names = grouped(list(dict.fromkeys(one_line(c.base) for c in clauses if one_line(c.base))))
        points = ""
        if len(clauses) == 1:
            marks = [m[1] for p in clauses[0].points if (m := re.match(r"\s*(\d+(?:\.\d+)*[.)]|[a-zA-ZđĐ][.)])", p))]
            points = grouped(list(dict.fromkeys(marks)))
        crumb = " > ".join(x for x in (self.chapter, self.article, names, points) if x)
        self.out.append(Chunk("article", self.chapter, self.article, " - ".join(x for x in (names, points) if x), crumb, content, self.appendix))

    def close(self) -> None:
        """Gives all that is gathered and forgets nothing."""
        self.give([*self.closed, *([self.open] if self.open else [])])

    def start(self, chapter: str | None = None, article: str = "", lead: str = "") -> None:
        """A new unit, after what was gathered is given."""
        self.close()
        if chapter is not None:
            self.chapter = chapter
        self.article, self.lead, self.closed, self.open = article, [lead] if lead else [], [], None

    def give_table(self) -> None:
        if self.rows and sum(ch.isalnum() for r in self.rows for ch in r) >= V.LEAST_CELLS:
            crumb = f"{self.article} > {TABLE_LABEL}" if self.article else TABLE_LABEL
            self.out.append(Chunk("table", self.chapter, self.article, "", crumb, "\n".join(self.header + self.rows).strip(), self.appendix))
        self.rows = []

    # --- lines of one kind ---
    def table_line(self, line: str) -> None:
        if not self.table:
            self.close()
            self.closed, self.open = [], None
            self.table, self.header, self.rows = True, [line], []
        elif not line.replace("|", "").replace("-", "").replace(":", "").strip() or (len(self.header) < 2 and not self.rows):
            self.header.append(line)
        else:
            if self.rows and (len(self.rows) >= V.TABLE_ROWS or sum(map(len, self.header + self.rows)) + len(line) > V.TABLE_LIMIT):
                self.give_table()
            self.rows.append(line)
            if len(self.rows) == 1 and len(line) > V.TABLE_LIMIT:
                self.give_table()

    def clause(self, ref: str, text: str) -> None:
        if self.open:
            before = sum(c.size for c in self.closed)
            if before + self.open.size > V.CLAUSE_LIMIT:
                self.give(self.closed if before else [self.open])
                self.closed, self.lead = [self.open] if before else [], []
            else:
                self.closed.append(self.open)
        self.open = Clause(ref, f"{ref} {text}".strip())

    def point(self, text: str) -> None:
        assert self.open
        if sum(c.size for c in self.closed) + self.open.size + len(text) > V.CLAUSE_LIMIT:
            self.close()
            self.closed, self.lead, self.open = [], [], self.open.resumed(text, True)
        else:
            self.open.points.append(text)

    def free(self, line: str) -> None:
        lead = sum(map(len, self.lead))
        if self.open:
            if sum(c.size for c in self.closed) + lead + self.open.size + len(line) > V.TEXT_LIMIT:
                self.close()
                self.closed, self.lead, self.open = [], [], self.open.resumed(line, bool(self.open.points))
            elif self.open.points:
                self.open.points[-1] += f"\n{line}"
            else:
                self.open.text += f"\n{line}"
            return
        if not self.article and not self.chapter:
            self.article = INTRODUCTION
        if lead + len(line) > V.TEXT_LIMIT:
            self.close()
            self.lead, self.closed = [], []
        self.lead.append(line)

    def line(self, number: int, line: str) -> None:
        """One physical line; the first rule that fits takes it."""
        if number < MOTTO_LINES and line.isupper() and any(m in line for m in MOTTO):
            return
        if FOOTER.match(line):
            self.appendix = False
            if self.article != SIGNATURE:
                self.start("", SIGNATURE)
        if line.count("|") >= 2:
            self.table_line(line)
            return
        if self.table:
            self.give_table()
            self.table, self.header = False, []
        if m := CHAPTER.fullmatch(line):
            self.start(one_line(f"{m[1]} {m[2]}"))
            self.appendix = False
        elif m := ARTICLE.fullmatch(line):
            if self.lead or self.closed or self.open:
                self.close()
            self.article, self.lead, self.closed, self.open = f"{m[1].strip()} {m[2].strip()}", [m[3].strip()] if m[3].strip() else [], [], None
            self.appendix = False
        elif self.article and not self.appendix and (m := next((x for p in CLAUSES if (x := p.fullmatch(line))), None)):
            self.clause(one_line(m[1]), one_line(m[2]))
        elif self.open and not self.appendix and (m := POINT.fullmatch(line)):
            self.point(f"{one_line(m[1])} {one_line(m[2])}")
        elif len(line) < 200 and ((a := APPENDIX.match(line)) or REGULATION.match(line)):
            self.start(one_line(line))
            self.appendix = bool(a) or bool(STANDARD.search(line))
        elif self.appendix and self.appendix_line(line):
            pass
        else:
            self.free(line)

    def appendix_line(self, line: str) -> bool:
        if m := PART.fullmatch(line):
            self.start(None, f"{m[1]} {m[2]}", m[3].strip())
        elif line.isupper() and 5 < len(line) < 150 and line[0] not in "IVXLCDM0123456789":
            self.start(None, line)
        elif m := LEVEL_1.fullmatch(line):
            self.start(None, one_line(f"{m[1]} {m[2]}"))
        elif m := LEVEL_2.fullmatch(line):
            self.clause(f"{m[1]}.", one_line(m[2]))
        elif self.open and (m := LEVEL_3.fullmatch(line) or POINT.fullmatch(line)):
            self.point(f"{one_line(m[1])} {one_line(m[2])}")
        else:
            return False
        return True

    def finish(self) -> list[Chunk]:
        if self.table:
            self.give_table()
        else:
            self.close()
        return self.out


def scan(text: str | None) -> list[Chunk]:
    """The chunks of one text, in order; an empty or null text has none."""
    scanner = Scanner()
    for number, line in enumerate((text or "").replace("\r\n", "\n").strip().splitlines()):
        if line.strip():
            scanner.line(number, line.strip())
    return scanner.finish()


_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in (
        ("chunk_index", T.IntegerType()), ("kind", T.StringType()), ("chapter_ref", T.StringType()), ("article_ref", T.StringType()), ("clause_ref", T.StringType()),
        ("breadcrumb", T.StringType()), ("content", T.StringType()), ("is_appendix", T.BooleanType()),
    )
])


def chunk_documents(documents: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """`keep` and one row per chunk: index from 1, kind, references, breadcrumb, content, appendix flag.

    Chunks without enough letters or cells are left out and take no index.
    Null and empty texts give no row. A text of any length is one row of
    input and is held whole by one task.
    """
    rows = documents.where(text.isNotNull()).select(text.alias("__text"), *[e.alias(n) for n, e in keep.items()])
    names = list(keep)
    schema = T.StructType([rows.schema[n] for n in names] + list(_SCHEMA))
    outer = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole["__text"]):
                batch = whole.slice(a, b - a)
                parent, values = [], []
                for i, value in enumerate(batch["__text"].to_pylist()):
                    for n, c in enumerate(scan(value), 1):
                        parent.append(i)
                        values.append((n, c.kind, c.chapter, c.article, c.clause, c.breadcrumb, c.content, c.appendix))
                columns = [batch[n].take(pa.array(parent, pa.int64())) for n in names]
                kinds = [pa.int32(), *[pa.string()] * 6, pa.bool_()]
                columns += [pa.array(list(c), k) for c, k in zip(zip(*values) if values else [[]] * 8, kinds)]
                yield pa.RecordBatch.from_arrays(columns, outer)

    return rows.mapInArrow(run, schema)


def citable(chunks: DataFrame, doc_id: Column, number: Column, title: Column, sectors: Column) -> DataFrame:
    """Chunks with id, citation, display text and text for embedding."""
    cut = F.when(F.length(title) > V.TITLE_CUT, F.concat(F.substring(title, 1, V.TITLE_CUT), F.lit("..."))).otherwise(title)
    return chunks.withColumns({
        "chunk_id": F.concat_ws("::", doc_id, F.col("kind"), F.concat(F.lit("c"), F.col("chunk_index"))),
        "reference_citation": F.concat(number, F.when(F.col("breadcrumb") != "", F.concat(F.lit(" | "), F.replace(F.col("breadcrumb"), F.lit(" > "), F.lit(" | ")))).otherwise("")),
        "chunk_text": F.concat(F.lit("Văn bản: "), number, F.lit(" - "), cut, F.lit("\nLĩnh vực: "), sectors, F.lit("\nĐiều khoản: "), F.col("breadcrumb"), F.lit("\nNội dung:\n"), F.col("content")),
        "text_to_embed": F.concat(F.lit("["), number, F.lit("] "), F.substring(title, 1, V.EMBED_CUT), F.lit("\n"), F.col("breadcrumb"), F.lit("\n"), F.col("content")),
    })


def table_of_contents(text: Column | str) -> Column:
    """Chapters and articles before the first appendix, one a line, titles cut at 100 characters; empty without any."""
    lines = F.transform(F.split(F.col(text) if isinstance(text, str) else text, r"\r?\n"), lambda x: F.trim(x))
    appendix = F.array_position(F.transform(lines, lambda l: l.rlike(r"(?iu)^(phụ\s+lục|danh\s+mục|(biểu\s+)?mẫu)(?U)\b").cast("string")), "true")
    main = F.when(appendix > 0, F.slice(lines, F.lit(1), F.greatest(appendix.cast("int") - 1, F.lit(0)))).otherwise(lines)
    chapter, article = r"(?iu)^(Chương|Phần)(?:\s+thứ)?\s+([a-zA-Z0-9]+)(?U)\b\s*[.:\-]?\s*(.*)$", r"(?iu)^(Điều|Mục)\s+(\d+[A-Za-z0-9/\-]*)\s*[.:\-]?\s*(.*)$"

    def entry(line: Column) -> Column:
        title = F.regexp_extract(line, article, 3)
        short = F.when(F.length(title) > V.TITLE_CUT, F.concat(F.substring(title, 1, V.TITLE_CUT), F.lit("..."))).otherwise(title)
        return (
            F.when(line.rlike(chapter), F.concat(F.regexp_extract(line, chapter, 1), F.lit(" "), F.regexp_extract(line, chapter, 2), F.lit(": "), F.regexp_extract(line, chapter, 3)))
            .when(line.rlike(article), F.concat(F.regexp_extract(line, article, 1), F.lit(" "), F.regexp_extract(line, article, 2), F.lit(". "), short))
        )

    return F.array_join(F.filter(F.transform(main, entry), lambda e: e.isNotNull()), "\n")


def effective_date(text: Column, promulgated: Column) -> Column:
    """The ISO day from which a document says it is in force; the promulgation day if from signing; else null. Appendices don't count."""
    main = F.regexp_extract(text, r"(?isu)^(.*?)(?:\n\s*(?:phụ\s+lục|danh\s+mục|mẫu\s+số)(?U)\b.*)?$", 1)
    part = [F.regexp_extract(main, V.EFFECTIVE_DAY, g) for g in (1, 2, 3)]
    return F.when(main.rlike(V.EFFECTIVE_DAY), F.concat_ws("-", part[2], F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0"))).when(main.rlike(V.EFFECTIVE_FROM_SIGNING), promulgated)
