"""Tags by patterns: one generated projection, whatever the number of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import FLAGS

# The tags of the literary corpus and their patterns.
LITERARY = {
    "char:thuy_kieu": [r"\bthúy?\s*kiều\b", r"\bvu(o|ơ)ng\s*thúy?\s*kiều\b"],
    "char:thuy_van": [r"\bthúy?\s*vân\b"],
    "char:kim_trong": [r"\bkim\s*trọng\b"],
    "char:tu_hai": [r"\bt(ừ|u)\s*h(ả|a)i\b"],
    "char:hoan_thu": [r"\bhoạn?\s*th(ư|u)\b"],
    "char:ma_giam_sinh": [r"\bm(ã|a)\s*gi(á|a)m\s*sinh\b"],
    "char:so_khanh": [r"\bs(ở|o)\s*khanh\b"],
    "char:tu_ba": [r"\bt(ú|u)\s*b(à|a)\b"],
    "char:giac_duyen": [r"\bgi(á|a)c\s*duy(ê|e)n\b"],
    "char:dam_tien": [r"\b(đ|d)ạm\s*ti(ê|e)n\b"],
    "char:vuong_quan": [r"\bv(ư|u)o(ng)?\s*quan\b"],
    "device:uoc_le": [r"\bước\s*lệ\b", r"\b(ước\s*lệ|tượng\s*trưng)\b"],
    "device:dien_co": [r"\bđi(ể|e)n\s*c(ố|o)\b", r"\bđi(ể|e)n\s*t(ích|ich)\b"],
    "device:an_du": [r"\bẩn\s*d(ụ|u)\b"],
    "device:nhan_hoa": [r"\bnhân\s*h(ó|o)a\b"],
    "device:ta_canh_ngu_tinh": [r"\bt(ả|a)\s*c(ả|a)nh\s*ng(ụ|u)\s*t(ì|i)nh\b"],
    "device:phung_du": [r"\bphúng\s*d(ụ|u)\b"],
    "device:cuc_ta": [r"\bc(ư|u)ờng\s*đi(ễ|e)m\b", r"\bph(ó|o)ng\s*đ(ạ|a)i\s*(ch(ử|u)|ph(á|a)p)\b"],
    "theme:tai_menh": [r"\bt(à|a)i\s*m(ệ|e)nh\b", r"\bt(à|a)i\s*v(ậ|a)n\b"],
    "theme:chu_tam": [r"\bch(ữ|u)\s*t(â|a)m\b"],
    "theme:nhan_dao": [r"\bnh(â|a)n\s*đ(ạ|a)o\b"],
    "theme:tinh_yeu": [r"\bt(ì|i)nh\s*y(ê|e)u\b", r"\bd(uy|uy)ên\b"],
    "theme:so_phan": [r"\bs(ố|o)\s*ph(ậ|a)n\b", r"\bb(ạ|a)c\s*m(ệ|e)nh\b"],
    "theme:gia_bien": [r"\bgia\s*bi(ế|e)n\b"],
    "section:trao_duyen": [r"\btrao\s*duy(ê|e)n\b"],
    "section:chi_khi_anh_hung": [r"\bch(í|i)\s*kh(í|i)\s*anh\s*h(ù|u)ng\b"],
    "section:bao_an_bao_oan": [r"\bb(á|a)o\s*(â|a)n\b.*b(á|a)o\s*(o|ô)an\b", r"\bth(ú|u)y\s*ki(ề|e)u\s*b(á|a)o\s*(â|a)n\b"],
    "section:gap_kim_trong": [r"\bg(ặ|a)p\s*kim\s*tr(ọ|o)ng\b"],
    "section:khoc_duong_truong": [r"\b(đ|d)o(à|a)n\s*tr(ư|u)ờng\s*t(â|a)n\s*th(à|a)nh\b"],
}
#: Tags that need all of several patterns.
LITERARY_ALL = {"device:uoc_le": [r"\bhoa\b", r"\bli(ễ|e)u\b"]}


def any_match(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(FLAGS + p)
    return out


def tag_array(text: Column, kind: Column, any_of: dict[str, list[str]], all_of: dict[str, list[str]] | None = None) -> Column:
    """Sorted distinct tags: those any of whose patterns match, those all of whose do, and the type."""
    text = F.coalesce(text, F.lit(""))
    found = [F.when(any_match(text, p), F.lit(tag)) for tag, p in any_of.items()]
    for tag, patterns in (all_of or {}).items():
        every = F.lit(True)
        for p in patterns:
            every = every & text.rlike(FLAGS + p)
        found.append(F.when(every, F.lit(tag)))
    found.append(F.concat(F.lit("type:"), kind))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def with_tags(docs: DataFrame, text: str = "text", kind: Column | None = None, any_of: dict[str, list[str]] | None = None, all_of: dict[str, list[str]] | None = None) -> DataFrame:
    literary = any_of is None
    return docs.withColumn("tags", tag_array(F.col(text), kind if kind is not None else F.col("type"), LITERARY if literary else any_of, LITERARY_ALL if literary else all_of))
