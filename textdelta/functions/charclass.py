"""Character classes, as Spark (Java) and DuckDB (RE2) write them."""

#: The White_Space property, ASCII punctuation, numeric characters.
SPACE = r"\p{IsWhite_Space}"
PUNCT = r"\p{Punct}"
NUMBER = r"\p{N}"
WORD = r"[^\p{N}\p{Punct}\p{IsWhite_Space}]"

SQL_SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL_PUNCT = r"[!-/:-@\[-`{-~]"
SQL_NUMBER = r"\p{N}"
SQL_WORD = r"[^\p{N}!-/:-@\[-`{-~\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Combining-mark blocks.
COMBINING_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
