"""Native schemas of the three reading-log tables and the category labels."""

from __future__ import annotations

from pyspark.sql import types as T

READER = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("user_nm", T.StringType()),
        T.StructField("user_email", T.StringType()),
    ]
)

SHELF = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("b_isbn", T.LongType()),
        T.StructField("b_title", T.StringType()),
        T.StructField("b_author", T.StringType()),
        T.StructField("b_dicount", T.LongType()),
        T.StructField("b_page", T.IntegerType()),
        T.StructField("b_category", T.StringType()),
        T.StructField("b_memo", T.StringType()),
        T.StructField("b_image", T.StringType()),
        T.StructField("b_mlday", T.StringType()),
        T.StructField("b_mlpage", T.StringType()),
        T.StructField("b_create_dt", T.DateType()),
        T.StructField("b_update_dt", T.DateType()),
        T.StructField("b_end_yn", T.StringType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("b_isbn", T.LongType()),
        T.StructField("r_date", T.DateType()),
        T.StructField("r_page", T.LongType()),
    ]
)



def text_keyed(schema: T.StructType) -> T.StructType:
    """The schema with login names and isbns as text, as the source tables hold them.

    The driver's tables have numeric keys; every operator keeps the key types of the tables it is given."""
    text = ("user_id", "b_isbn")
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in text else f for f in schema.fields])


# Catalog item as carried inside a search payload: every field is text.
CATALOG_ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("discount", T.StringType()),
        T.StructField("isbn", T.StringType()),
    ]
)
CATALOG_PAYLOAD = T.StructType([T.StructField("items", T.ArrayType(CATALOG_ITEM))])

SHELF_KEY = ["user_id", "b_isbn"]

# --- fixed values (must equal the original application's labels) ----------
# Category code -> label, scheme "kdc" (used by the dashboard, wish list,
# finished list and book detail):
#   000 총류, 컴퓨터과학 / 100 철학, 심리학, 윤리학 / 200 종교 / 300 사회과학 /
#   400 자연과학 / 500 기술과학 / 600 예술 / 700 언어 / 800 문학 / 900 역사
# Scheme "alt" (the shelf listing) differs only for 400..700:
#   400 어학 / 500 순수과학 / 600 기술과학 / 700 예술
# Any other code, including NULL, is labelled 기타.
CATEGORY_LABELS = {
    "kdc": {
        "000": "총류, 컴퓨터과학",
        "100": "철학, 심리학, 윤리학",
        "200": "종교",
        "300": "사회과학",
        "400": "자연과학",
        "500": "기술과학",
        "600": "예술",
        "700": "언어",
        "800": "문학",
        "900": "역사",
    },
    "alt": {
        "000": "총류, 컴퓨터과학",
        "100": "철학, 심리학, 윤리학",
        "200": "종교",
        "300": "사회과학",
        "400": "어학",
        "500": "순수과학",
        "600": "기술과학",
        "700": "예술",
        "800": "문학",
        "900": "역사",
    },
}
OTHER_LABEL = "기타"
# Unit suffixes and defaults of the dashboard tiles.
WON, PAGES_UNIT, BOOKS_UNIT, DAYS_UNIT = "원", "쪽", "권", "일"
NO_DATE, NO_BOOK = "00000000", "없음"
MONTH_SUFFIX = "월"
PAGE_SIZE = 10
# 'YYYY년 MM월 DD일' of a date tile; '... [12p/300p], 남은 페이지 : 288p' of a progress caption.
DATE_PARTS = ("년 ", "월 ", "일")
CAPTION_PARTS = (" (", ") [", "p/", "p], 남은 페이지 : ", "p")
# ---------------------------------------------------------------------------
