"""Rows that every operator must survive."""

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "one two three four"), (5, "one two three four"),
    (None, "one two three four"), (None, None), (6, "x" * 5000), (7, "12345 é ▁ 😀 <|endoftext|>"), (8, "A.\nB.\n\nC."),
]
