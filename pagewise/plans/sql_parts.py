"""DuckDB SQL fragments shared by the oracle statements (no Spark imports)."""

# RE2 spelling of the same whitespace class as functions.text.WS_CLASS
_WS_SQL = ("[ \\t\\n\\r\\f\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
           "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
_WORDS_SQL = ("CASE WHEN regexp_replace({x}, '^WS+|WS+$', '', 'g') = '' "
              "THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({x}, "
              "'^WS+|WS+$', '', 'g'), 'WS+') END").replace("WS", _WS_SQL)


def words_sql(x: str) -> str:
    return _WORDS_SQL.replace("{x}", x)
