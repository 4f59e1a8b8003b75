"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else normalize("NFKC", t) for t in texts], dtype=object)


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text (no built-in function does this); ASCII, which it leaves alone, is not sent to Python."""
    return F.coalesce(_nfkc(F.when(F.length(text) != F.octet_length(text), text)), text)


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def collapse(text: Column) -> Column:
    """White-space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_lines(text: Column) -> Column:
    """Line ends as \\n, no control characters, lines collapsed, at most one empty line in a row."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def strip_markup(html: Column) -> Column:
    """Text of simple markup: scripts and styles go, rows become lines with bars, blocks become lines."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|table|ul|ol|section|article)>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(value))
    return t


def decode_entities(text: Column) -> Column:
    """Numeric character references as the characters they name."""
    letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("long")), 8, "0")), "UTF-32")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,6});"), 1))
    return F.aggregate(found, text, lambda t, x: F.replace(t, F.concat(F.lit("&#"), x, F.lit(";")), letter(x)))


def preview(text: Column, size: int = 96) -> Column:
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("..."))).otherwise(text)


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^([^.!?\n]+[.!?])", 1), F.lit("")), text)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[ -]?)?\(?[0-9]{3}\)?[ -][0-9]{3,4}-[0-9]{4}(?![0-9])"


def scrub_contacts(text: Column) -> Column:
    """E-mail addresses and phone numbers removed, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, ""), PHONE, ""), " {2,}", " ")


def redact_lines(text: Column, labels: Sequence[tuple[str, str]]) -> Column:
    """A struct of the text without lines that open with a labelled field, without contacts, and the categories found.

    labels: (category, pattern of the field's label), tried in order.
    """
    lines = F.split(text, "\n")

    def category(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(labels):
            out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    dropped = F.filter(F.transform(lines, category), lambda c: c.isNotNull())
    kept = F.filter(lines, lambda x: category(x).isNull())
    contact = F.when(F.exists(kept, lambda x: x.rlike(EMAIL)), F.lit("EMAIL")), F.when(F.exists(kept, lambda x: x.rlike(PHONE)), F.lit("PHONE"))
    clean = F.filter(F.transform(kept, lambda x: F.when(x.rlike(EMAIL) | x.rlike(PHONE), F.regexp_replace(F.trim(scrub_contacts(x)), r"\s*:\s*$", "")).otherwise(x)), lambda x: x != "")
    found = F.array_sort(F.array_distinct(F.concat(dropped, F.array_compact(F.array(*contact)))))
    return F.struct(F.when(F.size(found) > 0, F.array_join(clean, "\n")).otherwise(text).alias("text"), found.alias("categories"))


# White space as the rules' own language has it, more than Java's \\s and other than Python's; digits are ASCII.
BLANKS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _blanks(pattern: str) -> str:
    return pattern.replace(r"\s", BLANKS).replace(r"\d", "[0-9]")


# What personal data looks like in programme texts, what makes an attachment a document of high risk.
PERSONAL_PHONE = _blanks(r"(?<![0-9A-Za-z])(?:0\d{1,2}\)?[- ]?\d{3,4}[- ]?\d{4})(?![0-9A-Za-z])")
PERSONAL_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PERSONAL_LINES = (
    ("BIRTH_DATE", r"(?:생년월일|생일|출생일)"),
    ("BANK_ACCOUNT", _blanks(r"(?:입금계좌|환불계좌|계좌번호|계좌|예금주)\s*[:：]?")),
    ("PRIVATE_ADDRESS", _blanks(r"(?:상세주소|거주지|주소)\s*[:：]?")),
    ("PERSON_NAME", _blanks(r"(?:(?:강사|담당자|사서|공무원|작성자)|(?:참여자|신청자|수강생|보호자|아동)\s*(?:이름|성명))\s*[:：]")),
)
PERSONAL_ROW = r"(?:이름|성명|신청자|참여자|수강생|보호자|강사|담당자)"
HIGH_RISK = _blanks(r"(?m)(?:참여자\s*명단|신청자\s*명단|수강생\s*명단|출석부|출석\s*명단|(?:^|\n)\s*신청서(?:\s|[:：]|$)|참가\s*신청서|개인정보\s*(?:수집[·ㆍ・.]?\s*이용|제공)\s*동의서|서명부|서명란|보호자\s*연락처|아동\s*정보|환불\s*계좌|강사\s*이력서|통장\s*사본|신분증\s*사본)")


# The same rules for a search by the JVM: a phone's 0 is looked for before what stands ahead of it, other patterns only where a Hangul letter is.
_ZERO_FIRST = PERSONAL_PHONE.replace(r"(?<![0-9A-Za-z])(?:0", r"(?:0(?<![0-9A-Za-z]0)", 1)
_HANGUL = "[가-힣]"
_AT_HANGUL = {name: rf"(?={_HANGUL})(?:{pattern})" for name, pattern in PERSONAL_LINES}
_ROW_AT_HANGUL = rf"(?={_HANGUL})(?:{PERSONAL_ROW})"
# A form's title may stand behind a line's beginning; whatever else is of high risk begins with a Hangul letter.
_FORM = _blanks(r"(?:^|\n)\s*신청서(?:\s|[:：]|$)")
_RISK_AT_HANGUL = f"(?m)(?={_HANGUL})" + HIGH_RISK.removeprefix("(?m)").replace(_FORM + "|", "", 1)
_BLANK_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def sanitised(text: Column, attachment: bool) -> Column:
    """A struct of the text without personal data and the sorted categories of what went.

    Lines that name a birth date, an account, an address, a person, or a person
    beside a contact go whole; other contacts are cut out.  A text without any hit
    stays as it is (line ends, control characters and outer blanks apart); an
    attachment that reads like a list of persons or a consent form goes altogether.
    ``sanitise`` is the same for one text.  A text is searched once for each rule,
    and by the slower ones only where a letter or sign that they need is.
    """
    has = lambda c, part: F.contains(c, F.lit(part))
    ends = lambda c: F.trim(c, F.lit(_BLANK_CHARS))
    read = F.coalesce(text, F.lit(""))
    source = ends(F.regexp_replace(F.regexp_replace(read, r"\r\n?", "\n"), "(?![ -~가-힣])" + CONTROLS, ""))
    none = F.array().cast("array<string>")

    def judged(line: Column) -> Column:
        return bound(F.struct(line.alias("line"), line.rlike(_ZERO_FIRST).alias("phone"), (has(line, "@") & line.rlike(PERSONAL_EMAIL)).alias("email"), line.rlike(_HANGUL).alias("hangul")), told)

    def told(x: Column) -> Column:
        line, phone, email, hangul = x["line"], x["phone"], x["email"], x["hangul"]
        contacts = F.when(phone | email, F.array_compact(F.array(F.when(phone, F.lit("PHONE")), F.when(email, F.lit("EMAIL"))))).otherwise(none)
        cut = F.when(phone, F.regexp_replace(line, _ZERO_FIRST, "")).otherwise(line)
        cut = F.when(phone | email, F.regexp_replace(cut, PERSONAL_EMAIL, "")).otherwise(cut)
        clean = F.regexp_replace(F.regexp_replace(cut, f"(?![!-~가-힣]){BLANKS}{{2,}}", " "), rf"(?![!-9;-~가-힣]){BLANKS}*+[:：]{BLANKS}*$", "")
        row = lambda value, found: F.struct(value.alias("value"), found.alias("found"))
        out = F.when((phone | email) & line.rlike(_ROW_AT_HANGUL), row(F.lit(""), F.concat(F.array(F.lit("PERSONAL_CONTACT_ROW")), contacts))).otherwise(row(ends(clean), contacts))
        for name, pattern in reversed(_AT_HANGUL.items()):
            out = F.when(hangul & line.rlike(pattern), row(F.lit(""), F.array(F.lit(name)))).otherwise(out)
        return out

    def whole(source: Column) -> Column:
        hit = source.rlike(_ZERO_FIRST) | (has(source, "@") & source.rlike(PERSONAL_EMAIL))
        hit = hit | source.rlike("|".join(f"(?:{pattern})" for pattern in _AT_HANGUL.values()))
        plain = F.struct(source.alias("text"), none.alias("categories"))
        out = F.when(hit, bound(F.transform(F.split(source, "\n"), judged), joined)).otherwise(plain)
        if attachment:
            risk = source.rlike(_RISK_AT_HANGUL) | (has(source, "신청서") & source.rlike("(?m)" + _FORM))
            out = F.when(risk, F.struct(F.lit("").alias("text"), F.array(F.lit("HIGH_RISK_DOCUMENT")).alias("categories"))).otherwise(out)
        return out

    def joined(lines: Column) -> Column:
        kept = F.filter(F.transform(lines, lambda x: x["value"]), lambda x: x != "")
        found = F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda x: x["found"]))))
        return F.struct(ends(F.array_join(kept, "\n")).alias("text"), found.alias("categories"))

    return bound(source, whole)


_ENDS = re.compile(rf"\A{BLANKS}+|{BLANKS}+\Z")
_CONTROLS, _RUNS, _OPEN_LABEL = re.compile(CONTROLS), re.compile(BLANKS + "{2,}"), re.compile(rf"{BLANKS}*[:：]{BLANKS}*\Z")
_CONTACTS = (("PHONE", re.compile(PERSONAL_PHONE)), ("EMAIL", re.compile(PERSONAL_EMAIL)))
_LINES = tuple((name, re.compile(pattern)) for name, pattern in PERSONAL_LINES)
_ROW, _RISK = re.compile(PERSONAL_ROW), re.compile(HIGH_RISK)


def sanitise(text: str | None, attachment: bool) -> tuple[str, list[str]]:
    """What ``sanitised`` gives for one text, for code that has it in a Python worker already; by the same patterns."""
    source = _ENDS.sub("", _CONTROLS.sub("", (text or "").replace("\r\n", "\n").replace("\r", "\n")))
    if attachment and _RISK.search(source):
        return "", ["HIGH_RISK_DOCUMENT"]
    if not any(p.search(source) for _, p in (*_CONTACTS, *_LINES)):
        return source, []
    kept, found = [], set()
    for line in source.split("\n"):
        named = next((name for name, p in _LINES if p.search(line)), None)
        if named:
            found.add(named)
            continue
        contacts = [name for name, p in _CONTACTS if p.search(line)]
        found.update(contacts)
        if contacts and _ROW.search(line):
            found.add("PERSONAL_CONTACT_ROW")
            continue
        for _, pattern in _CONTACTS:
            line = pattern.sub("", line)
        line = _ENDS.sub("", _OPEN_LABEL.sub("", _RUNS.sub(" ", line)))
        if line:
            kept.append(line)
    return _ENDS.sub("", "\n".join(kept)), sorted(found)


def comparison_key(title: Column) -> Column:
    """A title without bracketed tags, dates, times, round numbers, blanks and case."""
    t = F.regexp_replace(title, r"^((?:\[[^\]]+\]\s*)+)", "")
    t = F.regexp_replace(t, r"\([^)]*[0-9]{1,2}:[0-9]{2}[^)]*\)", "")
    t = F.regexp_replace(t, r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}", "")
    t = F.regexp_replace(t, r"(?i)\b(round|part|no\.?)\s*[0-9]+|#[0-9]+", "")
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")


def leading_tags(title: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(title, r"^((?:\[[^\]]+\]\s*)+)", 1), F.lit(r"\[([^\]]+)\]"), 1)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def labels_of(text: Column, rules: Sequence[tuple[str, str]], unknown: str = "UNKNOWN", cap: int | None = None) -> Column:
    """All labels whose pattern occurs, in rule order; the unknown label if none does."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules]))
    found = F.slice(found, 1, cap) if cap else found
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(unknown)))


def first_label(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def keywords(text: Column, stop: Sequence[str], size: int = 20) -> Column:
    found = F.array_distinct(F.array_except(terms(text), F.array(*map(F.lit, stop))))
    return F.slice(F.array_sort(F.filter(found, lambda t: F.length(t) >= 2)), 1, size)


def between_markers(text: Column, start: str, ends: Sequence[str], cap: int) -> Column:
    """What follows a marker up to the earliest of the end markers, at most ``cap`` characters; null without the marker."""
    at = F.locate(start, text)
    rest = F.substr(text, at + F.lit(len(start)))
    stops = [F.when(F.locate(e, rest) > 0, F.locate(e, rest)) for e in ends]
    size = F.coalesce(F.least(*stops) if len(stops) > 1 else stops[0], F.length(rest) + 1) - 1
    return F.when(at > 0, F.trim(F.substr(rest, F.lit(1), F.least(size, F.lit(cap)))))


# Words that extracted texts run together, and how they are written.
SPACING = (
    ("일본어글자쓰기읽기부터간단한대화까지할수있게함", "일본어 글자 쓰기·읽기부터 간단한 대화까지 할 수 있게 함"),
    ("중국어를가장좋아합니다", "중국어를 가장 좋아합니다"),
    ("주요형용동사단어접하기", "주요 형용동사 단어 접하기"),
    ("형용동사연습문제를통해복습하기", "형용동사 연습문제를 통해 복습하기"),
    ("오늘은매우춥네요", "오늘은 매우 춥네요"),
    ("사과가한개있습니다", "사과가 한 개 있습니다"),
    ("아침밥을먹다", "아침밥을 먹다"),
    ("동사구분규칙", "동사 구분 규칙"),
    ("주요동사의단어접하기", "주요 동사 단어 접하기"),
    ("그룹나누는연습", "그룹 나누는 연습"),
    ("존재동사의표현학습", "존재동사의 표현 학습"),
    ("주요형용사단어접하기", "주요 형용사 단어 접하기"),
    ("과거부정표현", "과거·부정 표현"),
    ("형용사의활용표현차이이해", "형용사의 활용 표현 차이 이해"),
    ("형용동사의활용표현차이이해", "형용동사의 활용 표현 차이 이해"),
    ("사물의개수를세는단위", "사물의 개수를 세는 단위"),
    ("사물의따라숫자발음달라짐", "사물에 따라 숫자 발음이 달라짐"),
    ("동사활용하기위한그룹을3개로나누는방법외우기", "동사 활용을 위한 그룹을 3개로 나누는 방법 외우기"),
    ("이내용이중요해서반복학습", "이 내용이 중요해서 반복 학습"),
    ("종합장과필기도구", "종합장과 필기도구"),
    ("교재필기구", "교재·필기구"),
    ("필기도구싸인펜", "필기도구·사인펜"),
    ("등등기억해오기", "등등 기억해오기"),
    ("역사와의의찾아보기", "역사와 의의 찾아보기"),
    ("활동경험해보기", "활동 경험해보기"),
)


# What a text has at least one of that the repair of its spacing changes.
_SPACED = r"(?U)[가-힣,]|\s\s|^ | $"


def spacing_repaired(text: Column) -> Column:
    """Known run-together words spaced, in order; a lesson's number and a fraction set apart, commas spaced but between digits, blanks collapsed."""
    return F.when(text.rlike(_SPACED), bound(text, _spacing)).otherwise(text)


def _spacing(text: Column) -> Column:
    known = text
    for before, after in SPACING:
        known = F.replace(known, F.lit(before), F.lit(after))
    text = F.when(text.rlike("|".join(before for before, _ in SPACING)), known).otherwise(text)  # most texts have none
    text = F.regexp_replace(text, r"(?U)^([0-9]+과)(?=\S)", "$1 ")
    text = F.regexp_replace(text, r"(합니다|네요|있습니다|읽습니다|먹다)(?=[0-9]/[0-9])", "$1 ")
    text = F.replace(text, F.lit("동사구분"), F.lit("동사 구분"))
    text = F.regexp_replace(text, r"(?U)(?<![0-9])\s*,\s*|\s*,\s*(?![0-9])", ", ")
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}", " "))


def activity_text(text: Column) -> Column:
    """Repaired text with its middle dots as bullets on lines of their own."""
    bullets = lambda t: F.regexp_replace(_spacing(t), r"(?U)\s*[ㆍ·․]\s*", "\n• ")
    return F.when(text.rlike(rf"{_SPACED}|[ㆍ·․\n]"), bound(text, lambda t: _without_blank_lines(bullets(t)))).otherwise(text)


def _without_blank_lines(bullets: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(bullets, "^\n", ""), "\n{2,}", "\n"))
