"""Text cleaning as native columns; the steps compose in a fixed order in ``clean_text``.

Word borders are ASCII look-arounds, as Java's own are Unicode-aware. Overlapping entities are decoded with the ampersand last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
SPACES = "                 　"
ZERO_WIDTH = "​‌‍﻿"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
TRADITIONAL = "國語書學習業務機會時間區門戶車馬鳥魚蟲龍鳳飛雲風電氣島腦網訊頭殼見視許號來裡認識開東萬與義這為過個們將對於說請問長舊難壞滿紅藍黃綠動靜輕軟淺遠夾"
SIMPLIFIED = "国语书学习业务机会时间区门户车马鸟鱼虫龙凤飞云风电气岛脑网讯头壳见视许号来里认识开东万与义这为过个们将对于说请问长旧难坏满红蓝黄绿动静轻软浅远夹"
#: Words that are replaced as wholes, before single signs: longer ones first, then by code point.
WORDS = tuple(sorted(zip(
    "系統 資料 處理 資訊 軟體 硬體 網路 網站 數據 設計 開發 測試 維護 應用 檔案 數據庫 連結 連接 設定 選項 參數 變量 函數 類別 實例 屬性 記錄 查詢 結果 輸出 輸入 顯示 頁面 視圖 樣式 腳本 代碼 編程 結構 架構 模組 組件 環境 技術 問題 解決 優化 質量 調試 錯誤 異常 日誌 監控 警報 帳戶 權限 認證 授權 登錄 註冊 賬號 密碼".split(),
    "系统 资料 处理 信息 软件 硬件 网络 网站 数据 设计 开发 测试 维护 应用 档案 数据库 链接 连接 设定 选项 参数 变量 函数 类别 实例 属性 记录 查询 结果 输出 输入 显示 页面 视图 样式 脚本 代码 编程 结构 架构 模块 组件 环境 技术 问题 解决 优化 质量 调试 错误 异常 日志 监控 警报 账户 权限 认证 授权 登录 注册 账号 密码".split(),
), key=lambda x: (-len(x[0]), x[0])))
WATERMARKS = "机密 内部文件 版权所有 未经授权 严禁传播".split()
WATERMARK_WORDS = ("CONFIDENTIAL", "INTERNAL", "COPYRIGHT", "UNAUTHORIZED", "DO NOT DISTRIBUTE")
STOP_WORDS = ("the and for with that this from are was were has have had not but you your his her its our they them their will would can could which what when where who how all any each more most other some such than then there these those into over also been being about".split())

_YEAR, _MONTH, _DAY = "(?:1[89]|20)[0-9]{2}", "(?:0[1-9]|1[012])", "(?:0[1-9]|[12][0-9]|3[01])"
ID_CARD = "[1-9][0-9]{5}" + _YEAR + _MONTH + _DAY + "[0-9]{3}[0-9Xx]"
BANK_CARD = "(?:62|4|5)[0-9]{14,17}"
LINK_URL = "https?://[^\\s<>\"{}|\\\\^`\\[\\]]+"


def let(c: Column, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def gate(c: Column, mark: str, f) -> Column:
    """``f`` where the text holds the mark; other texts pass at the price of one search."""
    return let(c, lambda x: F.when(x.contains(mark), f(x)).otherwise(x))


def decode_entities(c: Column) -> Column:
    def decode(x: Column) -> Column:
        for name, sign in ENTITIES:
            x = F.replace(x, F.lit(name), F.lit(sign))
        return x

    return gate(c, "&", decode)


def strip_tags(c: Column) -> Column:
    return gate(c, "<", lambda x: F.regexp_replace(x, "<[^>]*>", ""))


def clean_noise(c: Column) -> Column:
    """Entities, tags, control signs, Unicode spaces and zero-width signs, runs of space, ends."""
    c = F.regexp_replace(strip_tags(decode_entities(c)), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    c = F.translate(c, SPACES + ZERO_WIDTH, " " * len(SPACES))
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "))


def remove_links(c: Column) -> Column:
    """Markdown images go, Markdown links leave their text, bare addresses go."""
    c = gate(c, "](", lambda x: F.regexp_replace(F.regexp_replace(x, "!\\[[^\\]]*\\]\\([^)]+\\)", ""), "\\[([^\\]]+)\\]\\([^)]+\\)", "$1"))
    return gate(c, "://", lambda x: F.regexp_replace(x, LINK_URL, ""))


def normalize_paragraphs(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\\r\\n?", "\n"), "(?m)^\\t+", "")
    return F.regexp_replace(c, "\\n{3,}", "\n\n")


def remove_line_numbers(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^\\s*[0-9]+[.)]\\s+", "")


def half_width(c: Column) -> Column:
    return F.translate(c, WIDE + "　“”‘’", NARROW + " \"\"''")


def simplified(c: Column) -> Column:
    """Words of the table first, then single signs; texts without a Han sign pass."""
    def convert(x: Column) -> Column:
        for old, new in WORDS:
            x = F.replace(x, F.lit(old), F.lit(new))
        return F.translate(x, TRADITIONAL, SIMPLIFIED)

    return let(c, lambda x: F.when(x.rlike("[\u4e00-\u9fff]"), convert(x)).otherwise(x))


def remove_watermarks(c: Column) -> Column:
    """Marks of confidence and copyright go, wherever they stand; the English ones in any case."""
    def drop(x: Column) -> Column:
        for w in WATERMARKS:
            x = F.replace(x, F.lit(w), F.lit(""))
        for w in WATERMARK_WORDS:
            x = F.regexp_replace(x, f"(?i){w}", "")
        return x

    return let(c, lambda x: F.when(x.rlike("(?i)" + "|".join([*WATERMARKS, *WATERMARK_WORDS])), drop(x)).otherwise(x))


def clean(c: Column) -> Column:
    """Letters, numbers and common punctuation stay; all else and runs of space become one space."""
    c = F.regexp_replace(c, "[^\\p{L}\\p{N}\\t\\n\\f\\r .,;!?:'\"()。，、！？；：（）]", " ")
    return F.trim(F.regexp_replace(c, "[\\t\\n\\f\\r ]+", " "))


def normalize(c: Column) -> Column:
    return clean(F.lower(c))


def desensitize(c: Column) -> Column:
    """ID cards, phones, bank cards, keys and addresses, in this order; each kind becomes one fixed mask, of an address the domain stays."""
    def numbers(x: Column) -> Column:
        for pattern, mask in ((ID_CARD, "310***********1234"), ("1[3-9][0-9]{9}", "138****1234"), (BANK_CARD, "6222****1234")):
            x = F.regexp_replace(x, f"{LEFT}{pattern}{RIGHT}", mask)
        # with its dash a key of 36 signs may be an identifier and stays
        return F.regexp_replace(x, f"{LEFT}(?!(?:sk-|pk-)[A-Za-z0-9]{{33}}{RIGHT})(?<!(?:sk-|pk-)(?=[A-Za-z0-9]{{33}}{RIGHT}))(?:sk-|pk-|api_)?[A-Za-z0-9]{{32,}}{RIGHT}", "sk-****xxxx")

    c = let(c, lambda x: F.when(x.rlike("[0-9]{11}|[A-Za-z0-9]{32}"), numbers(x)).otherwise(x))
    return gate(c, "@", lambda x: F.regexp_replace(x, f"{LEFT}[0-9A-Za-z_][0-9A-Za-z_.+-]*@([0-9A-Za-z_.-]+\\.[a-zA-Z]{{2,}}){RIGHT}", "a***@$1"))


def clean_text(c: Column) -> Column:
    c = remove_watermarks(remove_line_numbers(remove_links(clean_noise(half_width(c)))))
    return clean(normalize_paragraphs(desensitize(simplified(c))))


def keywords(c: Column) -> Column:
    """Distinct words of two and more signs without stop words, in order; Han runs count as words (no dictionary)."""
    words = F.split(F.lower(c), "[^0-9a-z\\x{80}-\\x{10ffff}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*[F.lit(s) for s in STOP_WORDS]), w)))


def title_of(html: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


# ---- paths, dates, bytes

def extension(path: Column) -> Column:
    """Lower case, without the dot; empty where the file name has none."""
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/\\\\]*)$", 1)


def folder(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, "/[^/]*$", ""))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def mail_date(c: Column) -> Column:
    """RFC 822 dates as ISO 8601; null where there is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), "^[A-Za-z]{3},\\s*", ""), "\\s*\\([^)]*\\)$", "")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z")]), "yyyy-MM-dd'T'HH:mm:ssXXX")


def filetime(c: Column) -> Column:
    """100-nanosecond ticks since 1601 as a timestamp."""
    return F.timestamp_micros(F.floor(c / 10).cast("long") - F.lit(11_644_473_600_000_000))


def utf16(c: Column) -> Column:
    """Little-endian UTF-16 bytes as text, without what follows a zero sign."""
    return F.split_part(F.decode(c, "UTF-16LE"), F.lit("\0"), F.lit(1))


def repair_json(c: Column) -> Column:
    """The JSON of a model's answer: no fence, plain punctuation; a list ends at its last bracket or is closed; commas between objects, none before an end."""
    strip = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    c = F.regexp_replace(F.regexp_replace(strip(c), "^(?:```json)?(?:```)?", ""), "```$", "")
    c = F.translate(strip(c), "，：“”‘’【】（）", ",:\"\"''[]()")
    closed = F.when(F.instr(c, "]") > 0, F.regexp_extract(c, "(?s)^(.*\\])", 1)).otherwise(F.concat(c, F.lit("}]")))
    c = F.when(c.startswith("["), closed).otherwise(c)
    return F.replace(F.replace(c, F.lit("}{"), F.lit("},{")), F.lit(",]"), F.lit("]"))
