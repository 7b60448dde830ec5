"""Pieces of DuckDB SQL that the checking queries share."""

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{SPACE}+'), lambda x: x <> '')"


def trimmed(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def plain_words(t: str) -> str:
    return f"list_filter(list_transform({words(t)}, lambda x: trim(lower(x), '.,!?;:—«»\"…()[]')), lambda x: x <> '')"


def sentences(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({t}, '([.!?…]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trimmed('x')} <> '')"


def paragraphs(t: str, separator: str = "chr(10)") -> str:
    return f"list_filter(list_transform(string_split({t}, {separator}), lambda x: {trimmed('x')}), lambda x: x <> '')"
