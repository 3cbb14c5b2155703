"""Numbers, booleans, sizes and scores: Column to Column."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text

#: What counts as true and as false in sources.
TRUE_WORDS = ("true", "1", "yes", "y", "open", "public", "free", "available", "허용", "가능", "예", "있음", "무료")
FALSE_WORDS = ("false", "0", "no", "n", "none", "private", "restricted", "불가", "아니오", "없음", "비공개")
#: Bytes of each unit.
UNITS = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50}
_SIZE = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB|TB|PB|KiB|MiB|GiB|TiB|PiB)"


def parse_int(x: Column) -> Column:
    """The first whole number of a text, thousands commas apart; null without one."""
    return _whole(text.clean(x))


def _whole(plain: Column) -> Column:
    return F.regexp_extract(F.replace(plain, F.lit(",")), "-?[0-9]+", 0).try_cast("bigint")


def parse_float(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(text.clean(x), F.lit(",")), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def strict_int(x: Column) -> Column:
    """A text that is a whole number and nothing else."""
    return F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("bigint"))


def strict_float(x: Column, default: float) -> Column:
    """A text that is a number and nothing else, or ``default``."""
    return F.coalesce(F.when(F.trim(x).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.trim(x).try_cast("double")), F.lit(default))


def parse_bool(x: Column) -> Column:
    return text.let(F.lower(text.clean(x)), lambda word: F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)))


def parse_bytes(x: Column) -> Column:
    """Bytes of the first number with a unit ("1.5 GB", "3 MiB"); without one, of the first whole number."""
    factors = F.create_map(*(F.lit(v) for name, size in UNITS.items() for v in (name, float(size))))

    def read(plain: Column) -> Column:
        number = F.regexp_extract(plain, _SIZE, 1).try_cast("double")
        return F.coalesce(F.floor(number * F.try_element_at(factors, F.lower(F.regexp_extract(plain, _SIZE, 2)))), _whole(plain))

    return text.let(text.clean(x), read)


def unit_score(x: Column) -> Column:
    """A score in 0..1; above 1 it counts as percent."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))), 3)


def percent_score(x: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 100, 3)


def _trimmed(x: Column) -> Column:
    """A number without needless decimals."""
    return F.regexp_replace(x.cast("string"), r"\.0+$", "")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def compact_number(x: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    return (
        F.when(x >= 1_000_000, F.concat(_trimmed(_half_up(x / 100_000) / 10), F.lit("M")))
        .when(x >= 1000, F.concat(_trimmed(_half_up(x / 100) / 10), F.lit("K")))
        .otherwise(_trimmed(x))
    )


def millis(x: Column) -> Column:
    """Seconds as whole milliseconds."""
    return F.concat(_half_up(x * 1000).cast("string"), F.lit("ms"))


def daily_limit(x: Column) -> Column:
    return F.concat(F.format_number(x, 0), F.lit("/day"))


def shown_bytes(x: Column) -> Column:
    """Sizes in units of 1024, with one decimal below ten; null for nothing."""
    size, unit = x.cast("double"), F.lit("B")
    for k, name in enumerate(("KB", "MB", "GB", "TB"), 1):
        unit = F.when(x >= 1024**k, name).otherwise(unit)
        size = F.when(x >= 1024**k, x / float(1024**k)).otherwise(size)
    rounded = F.when((size >= 10) | (unit == "B"), _half_up(size).cast("double")).otherwise(_half_up(size * 10) / 10)
    return F.when(x > 0, F.concat(_trimmed(rounded), unit))


def percent_of_unit(x: Column) -> Column:
    """Scores of 0..1 as percent with one decimal; others as they are."""
    return F.when(x.between(0, 1), _half_up(x * 1000) / 10).otherwise(x)


def first_score(*candidates: Column) -> Column:
    """The first score that is a number, in percent."""
    return percent_of_unit(F.coalesce(*(c.try_cast("double") for c in candidates)))


def price_label(free: Column) -> Column:
    return F.when(free, "무료").when(~free, "유료").otherwise("-")


def yes_no_label(x: Column) -> Column:
    return F.when(x, "가능").when(~x, "불가능").otherwise("-")


def last_update_key(x: Column) -> Column:
    """The digits of a date as a number to sort by; 0 without any."""
    return F.coalesce(F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


#: Access types a source may state itself.
ACCESS_TYPES = ("OPEN", "REGISTERED", "APPROVAL", "PAID", "RESTRICTED", "UNKNOWN")


def access_type(explicit: Column, payment: Column, approval: Column, restricted: Column, login: Column) -> Column:
    """The explicit type if there is such a type, else by precedence of known flags; OPEN only where the first three are known to be false."""
    return F.coalesce(
        F.when(explicit.isin(*ACCESS_TYPES), explicit),
        F.when(payment, "PAID").when(approval, "APPROVAL").when(restricted, "RESTRICTED").when(login, "REGISTERED").when(~payment & ~approval & ~restricted, "OPEN").otherwise("UNKNOWN"),
    )


#: Licenses that forbid, and that allow, commercial use.
LICENSE_DENIES = (r"\bcc[-\s]?by[-\s]?nc(?:[-\s]?(?:sa|nd))?\b", r"\bnon[-\s]?commercial\b", r"\bnot\s+for\s+commercial\b", "비영리")
LICENSE_ALLOWS = (
    r"\bmit\b", r"\bapache(?:[-\s]?2(?:\.0)?)?\b", r"\bbsd(?:[-\s]?\d)?\b", r"\bcc0\b", r"\bcc[-\s]?by(?:[-\s]?(?:sa|nd))?\b", r"\bodc\b", r"\bpddl\b",
    r"\beuropean union public licence\b", r"\bgpl\b", r"\blgpl\b", r"\bmpl\b",
)


#: Edges of words in any alphabet, and of any regular expression engine.
_EDGES = (r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")


def license_pattern(words: tuple[str, ...]) -> str:
    """One pattern for license words, with edges that hold beside letters of any alphabet."""
    return "|".join(re.sub(r"\\b$", lambda _: _EDGES[1], re.sub(r"^\\b", lambda _: _EDGES[0], w)) for w in words)


def commercial_use(license_name: Column, license_url: Column | None = None) -> Column:
    """Whether a license allows commercial use; denials first, null where it does not say."""
    name = F.lower(F.concat_ws(" ", license_name, *([] if license_url is None else [license_url])))
    return F.when(name.rlike(license_pattern(LICENSE_DENIES)), F.lit(False)).when(name.rlike(license_pattern(LICENSE_ALLOWS)), F.lit(True))


#: Hints of a Korean catalogue that commercial use is forbidden, or allowed.
USE_DENIED = ("비영리", "변경금지", "금지", "불가", "금지됨", "prohibit")
USE_ALLOWED = ("허용", "가능", "제한 없음", "allowed", "yes")


def commercial_hint(x: Column) -> Column:
    """Commercial use by hints in a text. The hint "no" counts as a word of its own only, so that "technology" is no denial."""
    plain = F.lower(text.clean(x))
    return F.when(plain.rlike("|".join(USE_DENIED) + r"|\bno\b"), F.lit(False)).when(plain.rlike("|".join(USE_ALLOWED)), F.lit(True))


def payment_required(flag: Column, note: Column) -> Column:
    """Whether a record costs money, by its flag, else by its note."""
    f, n = F.lower(text.clean(flag)), F.lower(text.clean(note))
    by_flag = F.when(f.contains("무료") | f.isin("n", "no", "false", "0", "면제"), F.lit(False)).when(f.rlike("유료|비용") | f.isin("y", "yes", "true", "1"), F.lit(True))
    return F.coalesce(by_flag, F.when(n.rlike("무료|무상"), F.lit(False)).when(n.rlike("원|유료|과금|비용"), F.lit(True)))


def approval_required(review: Column, provided: Column) -> Column:
    """Whether someone has to approve, by the review, else by the way it is provided."""
    r, p = F.lower(text.clean(review)), F.lower(text.clean(provided))
    return F.coalesce(F.when(r.isin("-", "없음", "미해당", "자동"), F.lit(False)).when(r.rlike("심의|승인|검토|신청|approval"), F.lit(True)), F.when(p.rlike("신청|승인|approval"), F.lit(True)))


#: Marks of services that ask for no key.
NO_AUTH = ("none", "noauth", "public", "anonymous", "없음", "미필요", "불필요", "free")


def auth_required(auth_type: Column) -> Column:
    """Whether a service asks for a key: it says how, and not that there is none."""
    plain = F.lower(F.trim(auth_type))
    return F.coalesce((plain != "") & ~plain.rlike("|".join(NO_AUTH)), F.lit(False))


def stated_access(level: Column, kinds: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The access type that a source's own words for it stand for; ``otherwise`` for others and for none."""
    word = F.lower(text.clean(level))
    out = F.lit(otherwise)
    for kind, words in kinds.items():
        out = F.when(word.isin(*words), kind).otherwise(out)
    return out


#: Modalities and what names them, anywhere in a text.
MODALITIES = {
    "text": ("text", "문자", "텍스트", "corpus", "qa", "translation", "document", "pdf"),
    "image": ("image", "이미지", "사진", "jpg", "jpeg", "png", "segmentation", "object detection"),
    "audio": ("audio", "음성", "소리", "speech", "wav", "mp3"),
    "video": ("video", "영상", "동영상", "mp4", "avi"),
    "tabular": ("csv", "xlsx", "xls", "parquet", "table", "tabular", "structured", "정형", "표"),
    "multimodal": ("multimodal", "multi-modal", "멀티모달"),
    "geospatial": ("geospatial", "geojson", "shp", "wms", "지도", "공간", "satellite", "raster"),
    "time-series": ("time series", "timeseries", "시계열"),
    "3d": ("3d", "point cloud", "obj", "fbx", "mesh", "lidar"),
}


def modalities(x: Column) -> Column:
    """The modalities that a text names, in the order above."""

    def named(plain: Column) -> Column:
        any_of = lambda words: reduce(or_, (plain.contains(w) for w in words))
        return F.array_compact(F.array(*(F.when(any_of(words), F.lit(name)) for name, words in MODALITIES.items())))

    return text.let(F.lower(text.clean(x)), named)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is 0 or a length differs."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norms > 0) & (F.size(a) == F.size(b)), dot(a, b) / norms)


def l2_normalized(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
