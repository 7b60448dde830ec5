"""Text expressions: columns in, columns out; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the information separators, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Fixed value: characters trimmed from both ends of a word.
WORD_EDGES = '.,!?;:—«»"…()[]'
#: Fixed value: marks whose rate per 1000 words is reported, by label.
MARKS = {"«»": "«", "—": "—", "…": "…", ";": ";", ":": ":", "()": "("}
CHAPTER = "---CHAPTER---"

#: Function words left out of word rankings.
STOPWORDS = (
    "и в не на я что он с а как это по но к из то за его ещё она "
    "был бы мы ну вы ты уже от так все же всё мне ему было когда "
    "вот только при до где после нет ли если об ей ко мной них ней "
    "нас про нам нем без нее ими вам чем они каждый между "
    "тем кто тут ведь сам там еще свой себя свою этот вас чего "
    "или нибудь ни какой другой весь здесь может надо два мой раз "
    "будто чтобы другие лишь под через ото три ней знать уж никто "
    "опять наш больше однако именно должен перед более тебя хотя "
    "были была быть есть чтоб даже один этой одна"
).split()

#: Lines that open and close a digitised book's own text, in order of precedence.
BOOK_OPENS = [
    "*** START OF THIS PROJECT GUTENBERG",
    "*** START OF THE PROJECT GUTENBERG",
    "***START OF THIS PROJECT GUTENBERG",
    "*END*THE SMALL PRINT",
]
BOOK_CLOSES = [
    "*** END OF THIS PROJECT GUTENBERG",
    "*** END OF THE PROJECT GUTENBERG",
    "***END OF THIS PROJECT GUTENBERG",
    "End of the Project Gutenberg",
    "End of Project Gutenberg",
]
#: Openings of an instruction that a model repeated before its answer.
IMPERATIVES = [
    "Передайте", "Добавьте", "Подчеркните", "Подумайте", "Опишите", "Напишите", "Представьте", "Создайте", "Включите",
    "Используйте", "Покажите", "Расскажите", "Сделайте", "Обратите", "Уделите", "Пирожок", "Пишите",
]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Without building the words: runs of non-space characters."""
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def plain_words(text: Column) -> Column:
    """Lower-case words without the marks at their edges; words of marks alone go."""
    return F.filter(F.transform(words(text), lambda w: F.btrim(F.lower(w), F.lit(WORD_EDGES))), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?<=[.!?…]){SPACE}+"), lambda s: trimmed(s) != "")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    parts = F.transform(F.split(text, separator.replace("\\", "\\\\")), trimmed)
    return F.filter(parts, lambda p: p != "")


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("int")


def quoted_chars(text: Column, opening: str = "«", closing: str = "»") -> Column:
    """Characters inside quotes, the quotes not counted. An unclosed quote runs to the end; quotes don't nest.
    With one mark for both ends, marks open and close in turn."""
    if opening == closing:
        found = F.regexp_extract_all(text, F.lit(f"{opening}([^{opening}]*){opening}?"), F.lit(1))
        inside = found
    else:
        inside = F.transform(F.regexp_extract_all(text, F.lit(f"{opening}[^{closing}]*"), F.lit(0)), lambda m: F.replace(m, F.lit(opening), F.lit("")))
    return F.aggregate(inside, F.lit(0), lambda a, m: a + F.length(m))


def encoding_issues(text: Column) -> Column:
    """Names of signs of damaged encoding."""
    checks = {"null_bytes": "\x00", "replacement_chars": "�", "question_runs": "????"}
    return F.filter(F.array(*(F.when(F.contains(text, F.lit(v)), F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())


def without_book_frame(text: Column, opens: list[str] = BOOK_OPENS, closes: list[str] = BOOK_CLOSES) -> Column:
    """From the line after the first listed opening that occurs, up to the first listed closing that occurs."""
    at = F.coalesce(*(F.nullif(F.instr(text, m), F.lit(0)) for m in opens))
    line_end = F.call_function("locate", F.lit("\n"), text, at)
    body = F.when(at.isNotNull() & (line_end > 0), F.substring(text, line_end + 1, F.lit(2**31 - 1))).otherwise(text)

    def ended(b: Column) -> Column:
        end = F.coalesce(*(F.nullif(F.instr(b, m), F.lit(0)) for m in closes))
        return F.when(end.isNotNull(), F.substring(b, F.lit(1), end - 1)).otherwise(b)

    return F.transform(F.array(body), ended)[0]


def unwrapped(text: Column) -> Column:
    """Single line ends before a small ASCII letter become blanks; runs of blank lines become one."""
    joined = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?<!\n)\n(?!\n)(?=[a-z])", " ")
    return trimmed(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def collapsed(text: Column, most: int = 2) -> Column:
    """Runs of more than `most` line ends become `most` of them."""
    return F.regexp_replace(text, rf"\n{{{most + 1},}}", "\n" * most)


def dehyphenated(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def safe_name(text: Column, default: str = "untitled", longest: int = 200) -> Column:
    """A file name: no reserved characters, no dots or blanks at its ends."""
    bare = F.btrim(F.regexp_replace(text, r'[<>:"/\\|?*]', ""), F.lit(". "))
    cut = F.left(bare, F.lit(longest))
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def slug(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"(?U)[^\w\s-]", ""))


def unnumbered(line: Column) -> Column:
    return trimmed(F.ltrim(line, F.lit("0123456789.-) ")))


def clean_completion(text: Column, openings: list[str] = IMPERATIVES) -> Column:
    """Without special-token names, and without a first sentence that repeats the instruction."""
    bare = trimmed(F.regexp_replace(text, r"<SPECIAL_[0-9]+>", ""))
    starts = "^(?:" + "|".join(openings) + ")"
    return trimmed(F.when(bare.rlike(starts), F.regexp_replace(bare, rf"^[^.!?\n]+[.!?]{SPACE}*", "")).otherwise(bare))


def html_escaped(text: Column, breaks: bool = True) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("\n"), F.lit("<br>")) if breaks else F.replace(out, F.lit(">"), F.lit("&gt;"))


def unfenced(text: Column) -> Column:
    """The inside of a Markdown code fence."""
    return trimmed(F.regexp_replace(trimmed(text), r"(?s)^```[^\n]*\n(.*?)(?:```.*)?$", "$1"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def record_text(record_text: Column, messages: Column) -> Column:
    """A record's own text: its `text`, else what the assistant says, else nothing."""
    answer = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    return F.coalesce(record_text, answer, F.lit(""))
