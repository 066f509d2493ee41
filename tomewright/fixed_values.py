"""Fixed values.

Everything in this file must have exactly this value for results to be right:
the markers, field lines and constants that define the book-file format and the
weighting scheme.  Patterns are Java regular expressions; ``(?md)`` lets ``^``
match after every ``\\n`` and after nothing else.
"""

# Markers between license header, body and license footer of a book file; the name between the two parts is a parameter.
START_MARKER = (r"^\*{3} *START OF TH(?:IS|E) ", r"[^\*]+\*{3}")
END_MARKER = (r"^\*{3} *END OF TH(?:IS|E) ", r"[^\*]+\*{3}")

# Field lines of the header.
BOOK_ID = r"\[E(?:Book|text) (#[0-9]+)\]"
CHARSET_LINE = r"^Character set encoding: ([\p{L}\p{N}_]+)"
CHARSET_NAME_LINE = r"^Character set encoding: ([^\r\n]+)"
ASCII_LINE = r"^Character set encoding: ASCII"
LANGUAGE_LINE = r"^Language: "
GENOME_LINE = r"^Title: Human Genome Project"

# Preference between editions of one book, by declared character set.
RANK_UTF = 3
RANK_ASCII = 2
RANK_OTHER = 1

# Separators.
UNICODE_SEPARATOR = r"[^\p{L}\p{N}_]+"
ASCII_SEPARATOR = r"\W+"
LINE_SEPARATOR = "\r\n|\n|\r"

# Weighting and feature hashing.
TF_SMOOTHING = 0.4
VECTOR_SIZE = 10_000

# Metadata: the book id inside the ``about`` attribute.
ABOUT_ID = r"^ebooks/([0-9]+)"
TOP_SUBJECTS = 10
