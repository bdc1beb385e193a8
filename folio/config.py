"""Constants that change results. Equal to those of the system whose results are matched."""

K1, B = 1.2, 0.75  # BM25
RRF_K, GUARANTEED, DEPTH, DELIVERED = 60, 1, 50, 8  # fusion
CEILING, FLOOR = 1800, 120  # characters of a piece
PARTS_ON_PAGE, EMPTY_TITLES = 3, 4  # from how many on a page is a list of parts / an index
TOKENIZER_VERSION = "2"
CASED_MOST, GLUED_MOST = 5, 8  # longest token that keeps its case / that is glued
OPENING = 120  # characters of a piece that count as its opening
HEADING_MOST = 90
DIGEST_HEX = 16
SLUG_MOST = 24
EMBEDDING_BATCH = 16
EMBEDDING_MODEL = "bge-m3"
CASE_MARK = "|C"
# Function words, dropped from queries only.
FUNCTION_WORDS = (
    "a o as os um uma uns umas de do da dos das e ou em no na nos nas por para com sem sob sobre ao aos que qual quais quando onde como se ser "
    "sao foi era seu sua seus suas este esta esse essa isso aquilo entre ate apos antes mais menos muito pouco tambem ja nao sim"
).split()
