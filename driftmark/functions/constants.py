"""Word lists, patterns and thresholds whose exact content decides results."""

# Whitespace as the source texts are split (all Unicode space separators).
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"

# Token and sentence patterns.
ALPHA_WORD = r"[A-Za-z']+"
ALNUM_WORD = r"[A-Za-z0-9']+"
LOWER_ALNUM_WORD = r"[a-z0-9']+"
VECTORIZER_WORD = r"[\p{L}\p{N}_]{2,}"
MIXED_VIEW = r"[A-Za-z']+|\p{Nd}+|[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}]"
MIXED_PUNCT = r"[A-Za-z']+|[.,;:!?()\-]"
MIXED_DIGIT = r"[A-Za-z']+|[.,;:!?()\-]|\p{Nd}+"
SENTENCE_END = r"[.!?]+"
VOWELS = r"[aeiouyAEIOUY]+"

# The small stop-word list of the 14-column style block.
STOPWORDS_STYLE14 = """
the a an and or but if then so of in on at to for with as is are was were
be been being have has had do does did this that these those it its i you
he she we they him her his their our your my not no yes can will would
could should may might must from by about into over under again further
""".split()

# The stop-word list of the 18-column style block.
STOPWORDS_STYLE18 = """
the a an and or but of to in on for with as by at is are was were be this
that these those we our it its from which
""".split()

# The 197 function words of the wide style block.
FUNCTION_WORDS = """
the of and to in a is that for as are with on by this we be an which it from at
or our not can these have has was were been their its such also more most than then thus
however therefore moreover furthermore hence while whereas although though because since when where
how what who whom whose why if but so yet both either neither each every any all some no
none one two three many much few several other another same different new first second third last
next previous here there now thereby therein thereof wherein toward towards upon within without
into onto over under above below between among through throughout during before after against about
across along around behind beyond despite per via given based using used shown show shows propose
proposed present presents presented demonstrate achieve achieves achieved results result method methods
approach model models may might could would should must shall will cannot do does did being having
they them he she his her you your i my us me himself themselves itself very well only
even still just further particularly especially generally typically specifically respectively namely
e.g i.e et al
""".split()

# Hedging words and forms of "be" of the structural style block.
HEDGES = """
may might could possibly perhaps suggest suggests appear appears seem seems likely
potentially probably arguably presumably relatively somewhat generally typically often usually
""".split()
BE_FORMS = ["be", "been", "being", "is", "are", "was", "were", "am"]

# Words whose document rate is compared between the classes.
TELL_WORDS = [
    "delve", "intricate", "moreover", "furthermore", "realm", "showcase", "underscore",
    "leverage", "pivotal", "nuanced", "comprehensive", "notably", "tapestry", "boasts",
]

# Suffix rules of the pseudo part-of-speech view, first match wins.
POS_SUFFIXES = [
    (["ing"], "VBG"),
    (["ed"], "VBD"),
    (["ly"], "RB"),
    (["tion", "sion", "ment", "ness", "ity", "ance", "ence"], "NNZ"),
    (["ize", "ise", "ate", "ify"], "VB"),
    (["al", "ous", "ive", "ful", "able", "ible", "ic", "ary"], "JJ"),
    (["er", "or"], "NNR"),
]

# Column names of the style blocks.
STYLE14 = [
    "avg_word_len", "word_len_std", "big_word_ratio", "very_big_word_ratio",
    "avg_content_word_len", "avg_sentence_len", "type_token_ratio",
    "avg_syllables_per_word", "stopword_ratio", "punct_density",
    "commas_per_word", "digit_density", "upper_density", "long_sentence_flag",
]
STYLE_EXTRA4 = ["sentence_len_std", "unique_bigram_ratio", "avg_paragraph_len", "exclaim_question_ratio"]
STYLE18 = [
    "n_chars", "n_words", "avg_word_len", "word_len_std", "type_token_ratio",
    "n_sentences", "avg_sent_len", "sent_len_std", "comma_density",
    "period_density", "semicolon_density", "paren_density", "digit_ratio",
    "upper_ratio", "stopword_ratio", "unique_bigram_ratio", "hapax_ratio",
    "exclaim_question_ratio",
]
STYLE18_LENGTH_BOUND = [
    "n_chars", "n_words", "n_sentences", "avg_word_len", "word_len_std",
    "type_token_ratio", "unique_bigram_ratio", "avg_sent_len",
]
STYLE30 = [
    "avg_word_len", "word_len_std", "type_token_ratio", "hapax_ratio",
    "dis_legomena_ratio", "unique_bigram_ratio", "avg_sent_len",
    "sent_len_std", "sent_len_cv", "n_sentences_per_100w",
    "comma_density", "period_density", "semicolon_density", "colon_density",
    "paren_density", "quote_density", "dash_density", "question_density",
    "exclaim_density", "digit_ratio", "upper_ratio", "alpha_ratio",
    "space_ratio", "punct_ratio", "short_word_ratio", "long_word_ratio",
    "hedge_ratio", "be_ratio", "by_ratio", "stopword_mass",
]
SENTENCE6 = [
    "n_sentences", "sent_words_mean", "sent_words_std",
    "clauses_mean", "clauses_std", "long_sentence_share",
]
SURFACE15 = [
    "len_chars", "len_words", "avg_wlen", "n_commas", "n_semicolon", "n_emdash", "n_hyphen",
    "n_paren", "uniq_ratio", "digit_frac", "upper_frac", "newline", "double_space",
    "trailing_space", "nonascii",
]

# Crop lengths in whitespace tokens.
CROP, STRIDE, CROP_IF_LONGER = 187, 93, 321
CROP_SCALES = [130, 190, 279]
