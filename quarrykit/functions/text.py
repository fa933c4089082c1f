"""Caption predicates and text normalisation as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language thresholds of the non-English confidence cut.
LANGUAGE_THRESHOLDS = {
    "ja": 0.99, "ar": 0.99, "el": 0.99, "ru": 0.99, "th": 0.99, "zh": 0.96, "uk": 0.99, "he": 0.99, "ko": 0.99, "fa": 0.99, "hy": 0.99,
    "bn": 0.99, "arz": 0.95, "bg": 0.98, "hi": 0.98, "mn": 0.95, "kn": 0.99, "pa": 0.98, "ta": 0.99, "ml": 0.95, "sr": 0.95, "te": 1.0,
    "mr": 0.97, "gu": 0.99, "eo": 0.98, "ka": 0.96, "km": 0.97, "ur": 0.95, "ne": 0.95, "am": 0.95, "yi": 0.95, "ky": 0.95, "kk": 0.97,
    "ckb": 0.95, "be": 0.99, "si": 0.99, "fy": 0.95, "mk": 0.96, "as": 0.99, "sd": 0.97, "ug": 0.96, "or": 0.96, "wuu": 0.96, "my": 1.0,
    "bo": 0.99, "ba": 0.95, "cv": 0.99, "ps": 0.95, "tt": 0.95, "tg": 0.95, "dv": 0.95, "yue": 0.98, "lo": 0.95, "ce": 0.97, "new": 0.95,
}
# Languages kept at any confidence; the published levels of the language cut.
MAIN_LANGUAGES = ("de", "fr", "es", "it", "pt", "nl", "vi", "tr", "en")
LANGUAGE_LEVELS = (
    {"en": -1, "8lang": -1, "others": 0.2}, {"en": -1, "8lang": -1, "others": -1}, {"en": -1, "8lang": 0.2, "others": -1}, {"en": -1, "8lang": 0.4, "others": -1},
    {"en": 0.2, "8lang": 0.4, "others": -1}, {"en": 0.4, "8lang": 0.4, "others": -1}, {"en": 0.2, "8lang": 2, "others": -1}, {"en": 0.4, "8lang": 2, "others": -1},
)
# Patterns of captions that are file names, ids, links or resize directives; each is anchored at the start.
BAD_PREFIXES = (
    r"img_\S|photo_\d*$|table \d*$|thumb \d*$",
    r"f:id:\S*:\S*:\w*$",
    r"(?:http|ftp)s?://\S*$|www.\S*\.\S*$",
    r"rs=w:\d*,h:\d*\S*$",
)
# The lists of the bad-pattern test, in the order in which they are tried.
START_WORDS = (
    "phone number", "error_codes", "no_photo", "wechat", "facebook", "wikidata", "youtube", "[image", "ngc", "unnamed", "thumbnail", "mls:",
    "picture", "id", "guest", "tumblr", "logo", "qr", "blog", "default", "image", "imag", "imgp", "img", "asset", "iso", "apple", "table",
    "item", "dscn", "dsc", "微信用户", "微信图片", "icon", "video", "user", "scan", "fc2", "ref", "photo", "\\frac", "isbn", "slide", "unknown",
    "fifa", "bnsf", "cimg", "page",
)
REMOVED = (".jpeg", ".jpg", ".png", ".gif")
END_WORDS = ("datasheet", "@gmail.com", "icon", "thumbnail")
ROMAN = ("ii", "iii", "iv", "vi", "vii", "viii", "ix")
BAD_TEXTS = (
    "cleanup image.jpg", "image.assetalttext", "window display", "usericon", "top", "windows 10 icon",
    "{{.firstitem.brand.name}}({{.firstitem.brand.namekana}})の「{{.firstitem.name}}」を使った{{.posttype}}", "list icon", "favicon icon", "menu",
    "tinyurl.com", "gmail", "房屋?#35745;?", "user_icon", "message icon", "videothumbnail", "<img src=", "linkedin-icon", "google.site", "flag",
    "image module", "header", "page-header", "alttext", "userimage", "instagram-icon", "tiktok", "pagetop", "floorplan.alttag", "header2",
    "user-avatar", "filtr icon", "users icon", "rss icon", "menu-icon", "secret code", "flag icon", "heading icon", "web template", "unused",
    "header_img",
)
#: Characters that count as numeric besides Unicode's number categories.
CJK_NUMERALS = "一二三四五六七八九十百千万億兆零〇両壱弐参"


def words(c: Column) -> Column:
    """Tokens between runs of Unicode white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def long_enough(c: Column, more_words: int = 1, more_chars: int = 3) -> Column:
    """More than so many words and characters."""
    return (n_words(c) > more_words) & (F.length(c) > more_chars)


def unique_ratio(c: Column) -> Column:
    """Distinct share of the parts between single spaces; empty parts count."""
    parts = F.split(c, " ")
    return F.size(F.array_distinct(parts)) / F.size(parts)


def good_shape(width: Column, height: Column, least: int = 10, ratio: float = 4.0) -> Column:
    """The shorter side and the ratio of the sides; false if a side is missing."""
    low, high = F.least(width, height), F.greatest(width, height)
    both = width.isNotNull() & height.isNotNull()
    return F.coalesce(both & (low >= least) & (high <= low * ratio), F.lit(False))


def non_english_kept(lang: Column, score: Column) -> Column:
    """Dropped if the language is listed and the confidence reaches its threshold; unlisted ones stay."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_THRESHOLDS.items() for x in pair))
    return F.coalesce(score < F.try_element_at(table, lang), F.lit(True))


def language_kept(lang: Column, score: Column) -> Column:
    """Main languages at a score over -1, others up to 0.2."""
    return F.when(lang.isin(*MAIN_LANGUAGES), score > -1).otherwise(score <= 0.2)


def level_kept(lang: Column, score: Column, level: int) -> Column:
    """P09 with one of the published levels: English, eight other languages and the rest each have a least score."""
    t = LANGUAGE_LEVELS[level]
    least = F.when(lang == "en", F.lit(float(t["en"]))).when(lang.isin(*MAIN_LANGUAGES), F.lit(float(t["8lang"]))).otherwise(F.lit(float(t["others"])))
    return F.when(lang.isin(*MAIN_LANGUAGES), score > least).otherwise(F.when(F.lit(t["others"] < 0), F.lit(False)).otherwise(score <= least))


def no_bad_prefix(c: Column) -> Column:
    """P10."""
    low = F.lower(c)
    return ~reduce(lambda a, b: a | b, (low.rlike(f"^(?:{p})") for p in BAD_PREFIXES))


def _good_token(x: Column) -> Column:
    """Whether a token reads like a word; x: (t, letters), the token and its number of plain letters."""
    t, letters = x["t"], x["letters"]
    numeric = rf"[\p{{N}}{CJK_NUMERALS}]"
    runs = F.size(F.regexp_extract_all(t, F.lit(rf"{numeric}+|[^\p{{N}}{CJK_NUMERALS}]+"), F.lit(0)))
    n = F.length(t)
    return (n > 1) & ~t.isin(*ROMAN) & (letters > 1) & ~((letters <= 2) & (n - letters >= 3)) & ~((runs - 1 >= 2) & (n >= 4))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stripped_caption(c: Column) -> Column:
    """The lower-cased caption without file endings, the first listed start and the first listed end."""
    x = F.lower(c)
    for item in REMOVED:
        x = F.replace(x, F.lit(item), F.lit(""))
    start = "^(?:" + "|".join(rf"\Q{w}\E" for w in START_WORDS) + ")"  # of alternatives the first listed one matches
    x = F.regexp_replace(x, start, "")

    def without_end(y: Column) -> Column:
        end = reduce(lambda a, w: F.when(y.endswith(w), F.lit(len(w))).otherwise(a), reversed(END_WORDS), F.lit(0))
        return F.substr(y, F.lit(1), F.length(y) - end)

    return _let(x, without_end)


def no_bad_pattern(c: Column) -> Column:
    """Kept if any token reads like a word."""
    tokens = F.split(stripped_caption(c), r"(?U)[\s\-_.,]")
    return ~F.lower(c).isin(*BAD_TEXTS) & F.exists(tokens, lambda t: _let(F.struct(t.alias("t"), F.length(F.regexp_replace(t, "[^a-z]", "")).alias("letters")), _good_token))


def cut_key(c: Column) -> Column:
    """What is looked up among frequent bad texts."""
    return F.substring(F.lower(c), 1, 1000)


# ----------------------------------------------------------------- output cleaning


def clean_output(c: Column) -> Column:
    """X06."""
    return F.substring_index(F.lower(F.translate(c, "\n.,", "")), "<|endofchunk|>", 1)


def strip_punctuation(c: Column) -> Column:
    """No ASCII punctuation, lower case."""
    return F.lower(F.translate(c, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))


def yes_no(c: Column) -> Column:
    """Commas, then full stops, off both ends."""
    return F.lower(F.btrim(F.btrim(c, F.lit(",")), F.lit(".")))


def clean_question(c: Column, most: int = 128) -> Column:
    """Lower case, marks deleted, at most so many words."""
    plain = F.rtrim(F.translate(F.lower(c), ".!\"()*#:;~", ""))
    return F.array_join(F.slice(F.split(plain, " "), 1, most), " ")


def eval_tokens(c: Column) -> Column:
    """Lower case, no commas or question marks, 's set apart, stripped."""
    low = F.replace(F.replace(F.lower(c), F.lit(","), F.lit("")), F.lit("?"), F.lit(""))
    return F.btrim(F.replace(low, F.lit("'s"), F.lit(" 's")))


def flat_name(image: Column) -> Column:
    """A path as a file name."""
    return F.concat(F.substring(F.translate(image, "/.", "__"), 1, 200), F.lit(".json"))


def options_prompt(options: Column) -> Column:
    """Lettered options, one a line."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def subject_name(c: Column) -> Column:
    """Underscores to spaces, with one in front."""
    return F.concat(F.lit(" "), F.replace(c, F.lit("_"), F.lit(" ")))


def image_placeholders(c: Column) -> Column:
    """X28."""
    return F.regexp_replace(c, r"<image\s*\d+>", "<image>\n")


def cycled(values: Column, n: Column) -> Column:
    """The values repeated in order up to n of them; empty for n < 1."""
    return F.when(n < 1, F.slice(values, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.element_at(values, (F.pmod(i, F.size(values)) + 1).cast("int"))))


def coco_name(image_id: Column, split: str = "val2014") -> Column:
    """X29."""
    return F.format_string(f"COCO_{split}_%012d.jpg", image_id)
