"""Scoring of text boxes on signs: script, keywords, and the Latin text beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that point to newcomers and their firms.
MAINLAND_CJK = [
    "川菜", "湘菜", "东北", "東北菜", "兰州", "拉面", "沙县", "重庆", "火锅", "麻辣", "烧烤", "中国", "华为",
    "微信", "支付宝", "快递", "宿舍", "劳务", "项目部", "工程", "建设", "集团", "中建", "中铁", "中交",
    "青山", "德龙", "镍", "园区", "物流", "国际贸易", "进出口", "招聘", "中国人", "中餐", "家常菜", "饺子",
    "東北", "蘭州", "拉麵", "重慶", "火鍋", "燒烤", "中國", "華為", "快遞", "勞務", "項目部", "建設", "集團",
    "中鐵", "鎳", "園區", "國際貿易", "進出口", "餃子",
]
# Words that point to long-settled communities.
LOCAL_CJK = [
    "公会", "宗亲", "会馆", "會館", "庙", "廟", "宫", "宮", "堂", "坛", "壇", "寺", "祠", "社", "基金会",
    "基金會", "校友会", "校友會", "印尼", "印度尼西亚", "印度尼西亞", "中华", "中華", "华社", "華社",
    "孔教", "华文", "華文", "补习", "補習", "三语", "三語", "慈善", "联谊", "聯誼", "总会", "總會",
    "同乡", "同鄉", "大伯公", "妈祖", "媽祖", "观音", "觀音", "佛堂", "道堂",
]
# Everyday words of the national language, and loanwords in it.
INDONESIAN_WORDS = [
    "toko", "warung", "jalan", "jl", "rumah", "makan", "kopi", "apotek", "bank", "hotel", "dan", "jaya",
    "abadi", "makmur", "sejahtera", "bengkel", "salon", "klinik", "sekolah", "yayasan", "vihara", "kelenteng",
    "klenteng", "pt", "cv", "ud", "tb", "grosir", "eceran", "murah", "baru", "lama", "pusat", "cabang",
    "jam", "buka", "tutup", "dijual", "disewakan", "sewa", "ruko", "indah", "mulia", "sentosa", "bakti",
]
LOANWORDS = [
    "bakmi", "bakmie", "kwetiau", "kwetiaw", "bakpao", "bakso", "capcay", "cap", "go", "meh",
    "lontong", "kue", "tahu", "tauge", "mie", "mi", "kecap", "teh", "angpao", "hio", "pecinan",
]
# Fixed value: what a romanised syllable row looks like.
PINYIN = r"^(?:[bpmfdtnlgkhjqxzcsryw]?h?[aeiouü]{1,3}(?:ng?|r)?)+$"


# Traditional characters of the word lists above and their simplified forms.
TRADITIONAL = "東蘭麵慶鍋燒國華為遞勞務項設團鐵鎳園區際貿餃會館廟宮壇補習語聯誼總鄉媽觀亞"
SIMPLIFIED = "东兰面庆锅烧国华为递劳务项设团铁镍园区际贸饺会馆庙宫坛补习语联谊总乡妈观亚"


def to_simplified(text: Column) -> Column:
    """Text with the traditional characters that the word lists use in simplified form."""
    return F.translate(text, TRADITIONAL, SIMPLIFIED)

def count_cjk(text: Column) -> Column:
    """Han characters of the unified block and extension A."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]")), F.lit(0))


def script_of(text: Column, hint: Column) -> Column:
    """none without Han characters, else the detector's hint, else unknown."""
    return F.when(count_cjk(text) == 0, "none").otherwise(F.coalesce(F.nullif(hint, F.lit("")), F.lit("unknown")))


def latin_tokens(texts: Column) -> Column:
    """Lower-case Latin words of an array of texts."""
    words = F.flatten(F.transform(texts, lambda t: F.split(F.coalesce(t, F.lit("")), "[^A-Za-zÀ-ÿ]+")))
    return F.transform(F.filter(words, lambda w: w != ""), F.lower)


def _among(words: Column, known: list[str]) -> Column:
    listed = F.array(*map(F.lit, known))
    return F.filter(words, lambda w: F.array_contains(listed, w))


def score_sign(text: Column, script: Column, beside: Column) -> Column:
    """struct(sign_type, sign_score, sign_reasons) of a sign text, given the other texts of the image.

    Points for long-settled minus points for newcomers; 1 or more is local, -1 or less mainland.
    """
    tokens = latin_tokens(beside)
    own, loan = _among(tokens, INDONESIAN_WORDS), _among(tokens, LOANWORDS)
    long_ = F.filter(tokens, lambda w: F.length(w) >= 4)
    pinyin = (F.size(long_) > 0) & (F.size(own) == 0) & F.forall(long_, lambda w: w.rlike("(?i)" + PINYIN))
    found = lambda words: F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(to_simplified(text), to_simplified(k)))
    new, old = found(MAINLAND_CJK), found(LOCAL_CJK)
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    score = (
        points(F.size(own) > 0, 1.0) + points(F.size(loan) > 0, 1.0) - points(pinyin, 0.5)
        + points(script == "traditional", 1.0) - points(script == "simplified", 0.5)
        - points(F.size(new) > 0, 2.0) + points(F.size(old) > 0, 2.0)
    )
    three = lambda words: F.array_join(F.slice(words, 1, 3), ",")
    listed = lambda name, words: F.when(F.size(words) > 0, F.concat(F.lit(name + ":"), three(words)))
    why = F.concat_ws(
        ";", listed("indonesian", F.array_sort(F.array_distinct(own))), listed("loanword", F.array_sort(F.array_distinct(loan))),
        F.when(pinyin, "pinyin_only"), F.when(script.isin("traditional", "simplified"), script), listed("kw_mainland", new), listed("kw_local", old),
    )
    kind = F.when(score >= 1, "local").when(score <= -1, "mainland").otherwise("ambiguous")
    return F.struct(kind.alias("sign_type"), score.alias("sign_score"), why.alias("sign_reasons"))
