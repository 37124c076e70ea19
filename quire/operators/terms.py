"""Terminology: a locked dictionary as tables, longest-match lookup, candidate mining with counts and evidence, and merges.

A dictionary is entries(source, translation, type, gender, status, aliases array<struct<source, translation>>).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

#: Types of entries, names they had before, and word lists and patterns of the candidate rules.
VERSION = 10
SENTENCE_END = re.compile(r"[。！？!?；\n]")
TYPES = ["character", "location", "institution", "book_title", "memorial", "book_section", "term"]
OLD_TYPES = {
    "organization": "institution", "faction": "institution", "place": "location", "ability": "term", "technique": "term",
    "item": "term", "artifact": "term", "weapon": "term", "concept": "term", "work": "book_title",
}
PRONOUNS = ["他", "她", "它", "你", "我", "他们", "她们", "它们", "我们", "你们", "自己", "别人"]
GENERIC = ["使者", "众人", "大家", "朝廷", "大人", "先生", "小姐", "老人", "孩子", "男人", "女人", "全都", "尤其", "关键", "武功", "能力", "然后", "但是", "不然", "什么", "如何", "怎么"]
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费岑薛雷贺倪汤滕殷罗毕郝安常乐于时傅皮卞齐康伍余元卜顾孟平黄穆萧尹姚邵湛汪祁毛禹狄米贝明臧"
    "计伏成戴宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗宣丁邓郁单杭洪包左石崔吉龚程嵇邢滑裴陆荣翁荀羊惠甄曲家封芮储靳汲邴糜松井段富巫乌焦巴弓牧隗"
    "山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司黎薄印宿白怀蒲台从鄂索咸赖卓蔺屠蒙池乔阴胥能苍闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍璩桑桂濮牛寿边扈燕冀郏浦尚农温别庄晏柴瞿阎连茹习宦艾鱼容向古易慎戈廖庾终暨"
    "居衡步都耿满弘匡国文寇广禄阙东欧沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
)
DOUBLE_SURNAMES = ["欧阳", "上官", "司马", "诸葛", "夏侯", "东方", "慕容", "皇甫", "宇文", "令狐"]
BAD_START = "此那这时后前正已刚再又才便都也还很下个从以而因在对把被将让和与其别全尤关"
BAD_END = "笑看说道问答走来去想听见着了过地得的和与把将被就又才还都也很更在是有要以于"
FRAGMENT_STARTS = [
    "不是", "但是", "虽然", "因为", "由于", "所以", "如果", "否则", "正在", "已经", "从来", "从不", "不能", "你说", "全都", "尤其", "关键", "别", "自己", "别人", "他们", "她们", "我们", "你们", "他",
    "她", "它",
]
FRAGMENT_ENDS = ["不是", "但是", "来自于", "由于", "所以", "因为", "如果", "从", "以", "于", "而", "着", "了", "过", "呢", "吧", "吗", "么", "要", "却", "再", "还", "都", "也", "全"]
FRAGMENT_PARTS = ["不是", "但是", "来自于", "由于", "所以", "因为", "如果", "正在", "已经", "不能", "从不", "以为", "觉得", "然后"]
VERB_PHRASE = (
    "^(?:做|进行|使用|采取|拿起|看见|听见|说出|告诉|回答|询问|攻击|杀死|救下|离开|进入|走出|来到|站在|坐在|获得|得到|拥有|成为|变成|继续|开始|准备|完成|执行|"
    "运用|开启|关闭|吃掉|喝掉|写下|记下|练习)[㐀-鿿]{1,10}$"
)
ACTION_END = "(?:拿起|起来|转身|点头|摇头|看着|说着|想着|听着|轻声)$"
SUFFIXES = {
    "institution": ["公司", "集团", "组织", "协会", "学院", "宗门", "帮派", "神殿", "委员会", "研究所", "局", "司", "署", "衙门", "机关"],
    "location": ["城市", "城", "小镇", "村庄", "村", "山脉", "山", "大厦", "公园", "宫殿", "楼", "岛"],
    "term": [
        "数列", "曲线", "方盖", "太极图", "先天图", "制度", "学说", "理论", "方法", "算法", "定理", "公式", "原则", "效应", "定律", "结构", "关系", "模型", "概念", "体系", "主义", "思想", "技法", "功法",
        "法术", "剑法", "拳法", "图", "术", "诀", "阵", "曲", "率", "形", "体",
    ],
}
HAN = "[㐀-鿿]"
PATTERNS = {
    "declared": f"(?:名叫|名字叫|叫做|被称为|自称|号称|名为)\\s*({HAN}{{2,6}})",
    "named": f"({HAN}{{2,8}}(?:公司|集团|组织|协会|学院|宗门|帮派|神殿|城市|小镇|村庄|山脉|大厦|公园|宫殿|能力|异能|技能|功法|法术|神器|宝物|系统|计划|机关|衙门|研究所))",
    "action": f"(?:^|[。！？；，、：“「])\\s*({HAN}{{2,4}})(?=说|道|问|答|笑|看|想|走|来|去|听|见|点头|摇头|皱眉|开口)",
    "subject": f"(?:^|[。！？；，、：“「])\\s*({HAN}{{2,3}})(?=把|被|没有|没|不|已|就|还|这才|是|在|向|从|将|跟|与)",
    "titled": f"({HAN}{{1,3}}(?:探员|长官|先生|小姐|老板|队长|局长|老师|哥|姐))",
}
#: Fixed pattern: titles that end an alias.
TITLE_END = "(?:探员|长官|先生|小姐|老板|队长|局长|老师|哥|姐)$"
QUOTED = f"《({HAN}{{2,8}})》"
MARKERS = ["先生", "长官", "皇帝", "皇后", "协会", "宗门", "学院", "书院", "城", "担任", "任命", "名叫", "名为", "被称为", "称作", "创立", "提出", "发明", "著有", "来自"]


# ------------------------------------------------------------------ dictionary


def surfaces(entries: DataFrame) -> DataFrame:
    """(surface, owner, target) of each entry and alias."""
    own = F.array(F.struct(F.col("source").alias("surface"), F.col("translation").alias("target")))
    more = F.transform(F.coalesce("aliases", F.array().cast("array<struct<source:string,translation:string>>")), lambda a: F.struct(a["source"].alias("surface"), a["translation"].alias("target")))
    return entries.select(F.col("source").alias("owner"), F.explode(F.concat(own, more)).alias("s")).select("s.surface", "owner", "s.target")


def dictionary_problems(entries: DataFrame) -> DataFrame:
    """(source, problem): what keeps a dictionary from being locked; none if it is right."""
    trimmed = lambda c: c.isNotNull() & (c != "") & (c == X.strip(c))
    e = entries
    each = e.select(
        "source",
        F.when(~F.col("type").isin(TYPES) | F.col("type").isNull(), "unknown type")
        .when(~F.col("status").eqNullSafe(F.lit("locked")), "not locked")
        .when((F.col("type") != "character") & (F.col("gender") != "not_applicable"), "gender of a non-character")
        .alias("problem"),
    ).where("problem is not null")
    twice = e.groupBy("source").count().where("count > 1").select("source", F.lit("duplicate source").alias("problem"))
    s = surfaces(e)
    blank = s.where(~(trimmed(F.col("surface")) & trimmed(F.col("target")))).select(F.col("owner").alias("source"), F.lit("empty or untrimmed text").alias("problem"))
    own = s.groupBy("owner", "surface").count().where("count > 1").select(F.col("owner").alias("source"), F.lit("duplicate alias").alias("problem"))
    owners = s.groupBy("surface").agg(F.countDistinct("owner", "target").alias("n")).where("n > 1").select(F.col("surface").alias("source"), F.lit("several owners").alias("problem"))
    return each.unionByName(twice).unionByName(blank).unionByName(own).unionByName(owners).distinct()


def migrate(entries: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Entries of an older version in today's form, and what was changed: (source, field, was, now)."""
    old = F.create_map(*[F.lit(x) for pair in OLD_TYPES.items() for x in pair])
    e = entries.withColumns({"was_type": F.col("type"), "was_gender": F.col("gender")})
    e = e.withColumn("type", F.coalesce(old[F.col("type")], F.col("type")))
    e = e.withColumn("gender", F.when(F.col("type") != "character", "not_applicable").otherwise(F.coalesce("gender", F.lit("unknown"))))
    change = lambda f: F.when(~F.col(f"was_{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f"was_{f}").alias("was"), F.col(f).alias("now")))
    log = e.select("source", F.explode(F.array_compact(F.array(change("gender"), change("type")))).alias("c")).select("source", "c.*")
    if version != VERSION:
        log = log.unionByName(entries.sparkSession.createDataFrame([(None, "version", str(version), str(VERSION))], log.schema))
    return e.drop("was_type", "was_gender"), log


ENTRY = ["source", "translation", "type", "gender", "status", "aliases"]


def owner_proof(pairs: DataFrame, characters: DataFrame, raw: DataFrame) -> DataFrame:
    """pairs (owner, type, alias) -> with proven: does an alias belong to its owner beyond doubt?

    It does if a line of raw (text) has both; and for a character, if the alias starts with the surname and ends in a title while no other character has
    that surname, or starts with the name's last character and ends in 哥 or 姐 while no other character's name ends so. characters (source) are all there
    are. Lines meet surfaces by locked_matches(), so no line is compared with every surface.
    """
    wanted = pairs.select(F.explode(F.array("owner", "alias")).alias("surface")).distinct()
    numbered = raw.select(F.explode(X.split_lines(F.col("text"))).alias("line")).distinct()
    found = substrings(numbered, ["line"], "line", wanted)
    both = pairs.select("owner", "alias").distinct().join(found.select("line", F.col("surface").alias("owner")), "owner").join(found.select("line", F.col("surface").alias("alias")), ["line", "alias"])
    both = both.select("owner", "alias").distinct().withColumn("together", F.lit(True))
    c = characters.select("source").distinct()
    shared = lambda part, name: c.groupBy(part(F.col("source")).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("n").alias(name))
    head, tail = (lambda x: F.substring(x, 1, 1)), (lambda x: F.right(x, F.lit(1)))
    p = pairs.join(both, ["owner", "alias"], "left")
    p = p.join(shared(head, "same_head").withColumnRenamed("key", "head_"), head(F.col("owner")) == F.col("head_"), "left").join(shared(tail, "same_tail").withColumnRenamed("key", "tail_"), tail(F.col("owner")) == F.col("tail_"), "left")
    others = lambda n: F.coalesce(F.col(n), F.lit(0)) <= 1  # noqa: E731  (itself)
    titled = F.startswith("alias", head(F.col("owner"))) & F.col("alias").rlike(TITLE_END)
    familiar = F.startswith("alias", tail(F.col("owner"))) & F.col("alias").rlike("[哥姐]$")
    person = (F.col("type") == "character") & F.when(titled, others("same_head")).otherwise(familiar & others("same_tail"))
    return p.withColumn("proven", F.coalesce("together", F.lit(False)) | F.coalesce(person, F.lit(False))).select(*pairs.columns, "proven")


def merge_entries(entries: DataFrame, additions: DataFrame, raw: DataFrame, aliases: DataFrame | None = None, allow_unattested: bool = False) -> tuple[DataFrame, DataFrame]:
    """Add new entries and then new aliases (owner, alias, translation) that the texts of raw (text) have: (merged, problems: source, problem).

    All or nothing: what would be merged is checked whole, by itself, and with any problem the merged entries are those from before. An equal entry or
    alias again is no problem. allow_unattested: neither occurrence in raw nor proof of ownership is asked for.
    """
    have = surfaces(entries)
    new = additions.select(ENTRY).join(entries.select(ENTRY), ENTRY, "left_anti")
    own = surfaces(new)
    spark = entries.sparkSession
    extra = spark.createDataFrame([], "owner string, alias string, translation string") if aliases is None else aliases.select("owner", "alias", "translation")
    known = have.unionByName(own).select("owner", F.col("surface").alias("alias"), F.col("target").alias("translation"))
    extra = extra.join(known, ["owner", "alias", "translation"], "left_anti")
    every = entries.select("source", "type").unionByName(new.select("source", "type")).distinct()
    asked = own.select("owner", "surface").unionByName(extra.select("owner", F.col("alias").alias("surface"))).distinct()
    say = lambda d, source, text: d.select(F.col(source).alias("source"), F.lit(text).alias("problem"))
    problems = [
        say(new.where(source_problem(F.col("source")).isNotNull()), "source", "invalid source"),
        say(asked.where(F.col("surface") != F.col("owner")).where(source_problem(F.col("surface")).isNotNull()), "surface", "invalid alias"),
        say(asked.join(have.select("surface"), "surface", "left_semi"), "owner", "locked already"),
        say(extra.join(every, F.col("owner") == F.col("source"), "left_anti"), "owner", "unknown owner"),
    ]
    if not allow_unattested:
        found = substrings(raw.select("text").distinct(), ["text"], "text", asked.select("surface").distinct()).select("surface").distinct()
        problems.append(say(asked.join(found, "surface", "left_anti"), "owner", "unattested"))
        pairs = asked.where("surface <> owner").join(every, F.col("owner") == F.col("source")).select("owner", "type", F.col("surface").alias("alias"))
        problems.append(say(owner_proof(pairs, every.where("type = 'character'"), raw).where("not proven"), "alias", "owner not proven"))
    grown = entries.select(ENTRY).unionByName(new)
    more = extra.groupBy("owner").agg(F.collect_set(F.struct(F.col("alias").alias("source"), "translation")).alias("more"))
    empty = F.array().cast("array<struct<source:string,translation:string>>")
    grown = grown.join(more, F.col("source") == F.col("owner"), "left")
    grown = grown.withColumn("aliases", F.array_sort(F.concat(F.coalesce("aliases", empty), F.coalesce("more", empty)))).select(ENTRY)
    found = dictionary_problems(grown)
    for p in problems:
        found = found.unionByName(p)
    found = found.distinct()
    stop = found.limit(1).select(F.lit(True).alias("stop_"))
    gate = lambda d, how: d.join(F.broadcast(stop), F.lit(True), how)  # noqa: E731  (at most one row)
    same = entries.select(ENTRY).withColumn("aliases", F.array_sort("aliases"))
    return gate(grown, "left_anti").unionByName(gate(same, "left_semi")), found


def frozen_conflicts(entries: DataFrame, frozen: DataFrame) -> DataFrame:
    """Sources that a frozen older dictionary has with another translation, type, gender or status: (source, field, now, was)."""
    fields = ["translation", "type", "gender", "status"]
    j = entries.alias("a").join(frozen.alias("b"), "source")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("now"), F.col(f"b.{f}").alias("was"))) for f in fields]))
    return j.select("source", F.explode(differ).alias("d")).select("source", "d.*")


def take_over_frozen(entries: DataFrame, frozen: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A frozen dictionary's missing entries, and its entries' missing aliases, into a newer one: (merged, problems). A conflict refuses all."""
    missing = frozen.join(entries, "source", "left_anti")
    common = frozen.join(entries, "source", "left_semi").select(F.col("source").alias("owner"), F.explode("aliases").alias("a")).select("owner", F.col("a.source").alias("alias"), "a.translation")
    merged, problems = merge_entries(entries, missing, raw, common, allow_unattested=True)
    conflicts = frozen_conflicts(entries, frozen).select("source", F.concat(F.lit("frozen "), "field").alias("problem"))
    stop = conflicts.limit(1).select(F.lit(True).alias("stop_"))
    old = entries.select(ENTRY).withColumn("aliases", F.array_sort("aliases"))
    gated = merged.join(F.broadcast(stop), F.lit(True), "left_anti").unionByName(old.join(F.broadcast(stop), F.lit(True), "left_semi"))
    return gated, problems.unionByName(conflicts)


# ------------------------------------------------------------------ matching


def _taken(hits: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of (start, term) hits those that stay when longer ones go first, then those further left, and none overlaps one that stays."""
    starts: list[int] = []
    ends: list[int] = []
    out: list[tuple[int, str]] = []
    for start, term in sorted(hits, key=lambda h: (-len(h[1]), h)):
        end = start + len(term)
        k = bisect_right(starts, start)
        clear = (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end)
        if clear:
            starts.insert(k, start)
            ends.insert(k, end)
            out.insert(k, (start, term))
    return out


class Trie:
    """Finds every term at every place of a text in one pass."""

    def __init__(self, terms: Iterable[str]):
        from ahocorasick import Automaton

        self.automaton = Automaton()
        for t in terms:
            self.automaton.add_word(t, t)
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, str]]:
        return [(end + 1 - len(t), t) for end, t in self.automaton.iter(text)] if text and len(self.automaton) else []


#: Lengths of the prefixes that surfaces are looked up by: each surface has the longest that it is not shorter than.
PREFIXES = (1, 2, 4, 8, 16)
#: Code points of a text that are hashed at a time, whatever its length.
STRETCH = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _prefix_hashes(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(m, hashes of all runs of m code points) for each m of PREFIXES: a run's hash is made of those of its halves, so all places take a step for each doubling."""
    h = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    for m in PREFIXES:
        yield m, h
        if len(h) <= m:
            return
        h = _mixed(h[:-m] * np.uint64(0x9E3779B97F4A7C15) + h[m:])


class Filter:
    """A Bloom filter of the surfaces' prefixes, two bits for each; every prefix that a surface has passes it, and few others do while it isn't full."""

    def __init__(self, longest: dict[int, int], words: np.ndarray):
        self.longest, self.words, self.bits = longest, words, int(len(words) * 64).bit_length() - 1

    @staticmethod
    def places(h: np.ndarray, m: int, bits: int) -> Iterator[np.ndarray]:
        for k in (np.uint64(m), np.uint64(m + 100)):
            yield _mixed(h + k) >> np.uint64(64 - bits)

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(position, m, what stands there, as long as a surface may be and two more)."""
        out = []
        for at in range(0, len(text or ""), STRETCH):
            for m, h in _prefix_hashes(text[at : at + STRETCH + PREFIXES[-1] - 1]):
                if m in self.longest and len(h):
                    hit = np.ones(len(h), bool)
                    for p in self.places(h, m, self.bits):
                        hit &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
                    out += [(at + int(k), m, text[at + k : at + k + self.longest[m] + 2]) for k in np.flatnonzero(hit[:STRETCH])]
        return out


def _filter(surfaces_: DataFrame, most_bits: int) -> Filter | None:
    """32 bits a surface, in a power of two of at most most_bits: the words of bits come together by an OR, so the driver gets the filter and no surface."""
    longest = {r["m"]: r["n"] for r in surfaces_.groupBy("m").agg(F.max(F.length("surface")).alias("n")).collect()}
    if not longest:
        return None
    bits = max(7, min(most_bits.bit_length() - 1, (32 * surfaces_.count()).bit_length()))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [p for x in batch["prefix"] for m, h in _prefix_hashes(x) if m == len(x) for p in Filter.places(h, m, bits)]
            p = np.concatenate(at) if at else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": (p >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (p & np.uint64(63))).view(np.int64)})

    rows = surfaces_.select("prefix").distinct().mapInPandas(set_bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows:
        words[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return Filter(longest, words)


def _found(texts: DataFrame, keys: list[str], text: str, surfaces_: DataFrame, most_bits: int) -> DataFrame:
    """(r_, keys, position, surface) of all surfaces at all places; r_ is the text's row.

    A text sends only places where it has the prefix of a surface, as told by a filter that every task gets; they meet the surfaces of that prefix by an equality join, and
    those that go on as the text does are found. One plan for any number of surfaces: they are only ever joined, and the filter's size is bounded (a full one lets more
    places pass, and loses none).
    """
    s = surfaces_.select("surface").where("surface <> ''").distinct()
    m = F.greatest(*[F.when(F.length("surface") >= n, F.lit(n)) for n in PREFIXES])
    s = s.withColumn("m", m).withColumn("prefix", F.substring(F.col("surface"), F.lit(1), F.col("m")))
    own = texts.select(F.monotonically_increasing_id().alias("r_"), *keys, F.col(text).alias("t_"))
    bloom = _filter(s, most_bits)
    if bloom is None:
        return own.select("r_", *keys, F.lit(0).alias("position"), F.col("t_").alias("surface")).where("false")
    shared = texts.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("array<struct<position:int,m:int,rest:string>>")
    def places(values: pd.Series) -> pd.Series:
        return values.map(shared.value.find)

    p = own.select("r_", *keys, F.explode(places("t_")).alias("p_")).select("r_", *keys, "p_.*").withColumn("prefix", F.substring(F.col("rest"), F.lit(1), F.col("m")))
    j = p.alias("p").join(s.alias("s"), (F.col("p.m") == F.col("s.m")) & (F.col("p.prefix") == F.col("s.prefix")) & F.startswith("p.rest", "s.surface"))
    # A fixed exception: this institution's name inside an enumeration of variables.
    j = j.where(~((F.col("s.surface") == "里甲") & (F.substring("p.rest", 3, 2) == "乙丙")))
    return j.select("p.r_", *[F.col(f"p.{k}") for k in keys], "p.position", "s.surface")


def substrings(texts: DataFrame, keys: list[str], text: str, surfaces_: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """(keys, surface) of the surfaces that each text has anywhere, once each; overlaps count."""
    return _found(texts, keys, text, surfaces_, most_bits).select(*keys, "surface").distinct()


def locked_matches(paragraphs: DataFrame, keys: list[str], text: str, surfaces_: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """(keys, position, surface) of the dictionary's surfaces in each text: the longest first, then the leftmost, none overlapping.

    All places come from _found(), whatever the dictionary's size; a text's own are then settled in its row, which has a place or less for each of its letters.
    Null and empty texts and surfaces match nothing; rows with equal keys are settled each by itself.
    """
    hits = _found(paragraphs, keys, text, surfaces_, most_bits).groupBy("r_", *keys).agg(F.collect_list(F.struct("position", "surface")).alias("hits"))

    @F.pandas_udf("array<struct<position:int,surface:string>>")
    def settle(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"position": p, "surface": s} for p, s in _taken((h["position"], h["surface"]) for h in v)])

    return hits.select(*keys, F.explode(settle("hits")).alias("m")).select(*keys, "m.position", "m.surface")


def relevant_entries(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Entries of which a surface is matched."""
    owners = surfaces(entries).join(matches.select("surface").distinct(), "surface", "left_semi").select(F.col("owner").alias("source")).distinct()
    return entries.join(owners, "source", "left_semi")


# ------------------------------------------------------------------ candidates


def source_problem(c: Column) -> Column:
    """Why a candidate is no term, by the first rule that it breaks; null if it may be one."""
    first, last = F.substring(c, 1, 1), F.right(c, F.lit(1))
    long = F.length(c) >= 3
    return (
        F.when(c.isin(PRONOUNS) | c.isin(GENERIC) | ~c.rlike(f"^{HAN}+$") | c.isNull(), "pronoun, generic role, or non-Chinese source")
        .when((F.length(c) < 2) | (F.length(c) > 12) | (long & F.contains(F.lit(SURNAMES), first) & F.contains(F.lit(BAD_END), last)), "contextual/action fragment")
        .when(c.rlike(f"^(?:{'|'.join(FRAGMENT_STARTS)})") | c.rlike(f"(?:{'|'.join(FRAGMENT_ENDS)})$") | c.rlike("|".join(FRAGMENT_PARTS)), "sentence fragment")
        .when(c.rlike(VERB_PHRASE), "verb phrase")
        .when(long & F.contains(F.lit(BAD_START), first) & ~F.substring(c, 1, 2).isin(DOUBLE_SURNAMES), "contextual/action fragment")
        .when(c.rlike(ACTION_END), "contextual/action fragment")
    )


def possible_type(c: Column, evidence: Column) -> Column:
    """The type that a candidate's form or its evidence (one text) suggests; null if none."""
    ends = lambda kind: c.rlike("(?:" + "|".join(SUFFIXES[kind]) + ")$")
    surname = F.substring(c, 1, 2).isin(DOUBLE_SURNAMES) | F.contains(F.lit(SURNAMES), F.substring(c, 1, 1))
    kind = (
        F.when(F.array_contains(F.regexp_extract_all(evidence, F.lit(f"《({HAN}{{2,12}})》"), F.lit(1)), c), "book_title")
        .when(ends("institution"), "institution")
        .when(ends("location"), "location")
        .when(ends("term"), "term")
        .when(F.length(c).between(2, 4) & surname, "character")
        .when(evidence.rlike("被称为|名为|称作|定理|公式|数列"), "term")
        .when((F.length(c) >= 3) & evidence.rlike("名字|名称|名叫|出自|著有"), "unknown")
    )
    return F.when(source_problem(c).isNull(), kind)


def _hits(text: Column, patterns: dict[str, str], gate: bool) -> Column:
    """Distinct finds of the patterns in a text. gate: what `action` and `subject` find has to start with a surname and be no longer than it and two characters."""

    def person(c: Column) -> Column:
        double = F.substring(c, 1, 2).isin(DOUBLE_SURNAMES)
        first = F.substring(c, 1, 1)
        return (double | F.contains(F.lit(SURNAMES), first)) & (F.length(c) <= F.when(double, 4).otherwise(3)) & ~F.contains(F.lit(BAD_START), first)

    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns.values()]
    found = [F.filter(x, person) if gate and name in ("action", "subject") else x for name, x in zip(patterns, found, strict=True)]
    return F.array_distinct(F.concat(*found))


def candidates(paragraphs: DataFrame, chapter: str, position: str, text: str, patterns: dict[str, str] | None = None, gate: bool = True) -> DataFrame:
    """(chapter, position, source) of what the patterns find in each text, once for each text."""
    return paragraphs.select(chapter, position, F.explode(_hits(F.col(text), patterns or PATTERNS, gate)).alias("source"))


def mined(paragraphs: DataFrame, chapter: str, position: str, text: str, patterns: dict[str, str] | None = None, gate: bool = True) -> DataFrame:
    """(source, chapter, position, n, sentence): candidates with how often their text has them, and the first sentence that does.

    Found, counted and quoted in the text's own row, so that no text is joined to its candidates or leaves its row: all of a text's finds are counted in one pass over it,
    by a trie. The patterns' finds have no mark that ends a sentence in them.
    """

    @F.pandas_udf("array<struct<source:string,n:int,sentence:string>>")
    def counted(texts: pd.Series, hits: pd.Series) -> pd.Series:
        def one(t: str, terms: Iterable[str]) -> list[dict]:
            ends = [m.end() for m in SENTENCE_END.finditer(t)]
            first, last, n = {}, {}, {}
            for start, term in Trie(terms).hits(t):
                if start >= last.get(term, 0):  # occurrences of one term don't overlap
                    first.setdefault(term, start)
                    last[term], n[term] = start + len(term), n.get(term, 0) + 1
            out = []
            for term, start in first.items():
                k = bisect_right(ends, start)
                out.append({"source": term, "n": n[term], "sentence": t[ends[k - 1] if k else 0 : ends[k] if k < len(ends) else len(t)]})
            return out

        return pd.Series([one(t, h) for t, h in zip(texts, hits, strict=True)])

    p = paragraphs.select(F.col(chapter).alias("chapter"), F.col(position).alias("position"), F.col(text).alias("text"))
    p = p.select("*", _hits(F.col("text"), patterns or PATTERNS, gate).alias("hits")).where(F.size("hits") > 0)
    return p.select("chapter", "position", F.explode(counted("text", "hits")).alias("z")).select("z.source", "chapter", "position", "z.n", X.strip(F.col("z.sentence")).alias("sentence"))


def not_owned(found: DataFrame, owned: DataFrame) -> DataFrame:
    """Candidates that are no surface and no part of one: owned (surface) is cut into its substrings, so that the join is by equality."""
    part = F.flatten(F.transform(F.sequence(F.lit(1), F.length("surface")), lambda p: F.transform(F.sequence(F.lit(1), F.length("surface") - p + 1), lambda n: F.substring(F.col("surface"), p, n))))
    parts = owned.where("surface <> ''").select(F.explode(F.array_distinct(part)).alias("source")).distinct()
    return found.join(parts, "source", "left_anti")


def occurrences(found: DataFrame, paragraphs: DataFrame, chapter: str, position: str, text: str) -> DataFrame:
    """(source, chapter, position, n, sentence) for each text with a candidate: how often it has it, and the sentence around the first. A text meets the list of its
    candidates, not each of them."""
    own = found.groupBy(chapter, position).agg(F.collect_set("source").alias("hits"))
    j = paragraphs.select(F.col(chapter), F.col(position), F.col(text).alias("t_")).join(own, [chapter, position])
    z = F.transform("hits", lambda h: F.struct(h.alias("source"), X.count_of(F.col("t_"), h).alias("n"), X.sentence_around(F.col("t_"), h).alias("sentence")))
    return j.select(F.col(chapter).alias("chapter"), F.col(position).alias("position"), F.explode(z).alias("z")).select("z.source", "chapter", "position", "z.n", "z.sentence")


def evidence_score(c: Column, markers: list[str] = MARKERS) -> Column:
    """80 for each marker in a text, and its length up to 220, less a quarter of what is above."""
    marks = sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return marks * 80 + F.least(F.length(c), F.lit(220)) - F.floor(F.greatest(F.lit(0), F.length(c) - 220) / 4)


def best_evidence(evidence: DataFrame, order: str = "position", limit: int = 5, markers: list[str] = MARKERS) -> DataFrame:
    """evidence (source, chapter, sentence, order) -> at most limit rows a source: all distinct ones if they fit. Else the best of each chapter; if those are
    more, the first and the last chapter's and the best of the rest; if fewer, filled up with the best others. Ties go to the earlier row.

    Every sort of a whole source is a row number kept up to limit, which Spark cuts off before the shuffle, and the rest are sums made before it; so a source
    with a third of all rows sends few of them.
    """
    # Dealt by source and chapter once, which the sums by sentence and the numbers in a chapter both go by.
    e = evidence.where(X.has_text(F.col("sentence"))).repartition("source", "chapter").groupBy("source", "chapter", "sentence").agg(F.min(order).alias("o"))
    e = e.withColumn("score", evidence_score(F.col("sentence"), markers))
    best = [F.col("score").desc(), F.col("chapter").asc_nulls_last(), F.col("o"), F.col("sentence")]
    own = Window.partitionBy("source", "chapter").orderBy(F.col("score").desc(), "o", "sentence")
    e = e.withColumn("top", F.row_number().over(own) == 1)
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("source", "top").orderBy(*best))).where(F.col("r") <= limit)
    row, place = F.struct("chapter", "sentence", "score", "o"), F.struct(F.col("chapter").isNull(), "chapter")
    tops = e.where("top").groupBy("source").agg(F.count("*").alias("chapters"), F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    ends = tops.where(F.col("chapters") > limit).select("source", F.explode(F.array("first", "last")).alias("x")).select("source", "x.*", F.lit(0).alias("rank"))
    rest = ranked.select("source", "chapter", "sentence", "score", "o", F.when(F.col("top"), 1).otherwise(2).alias("rank"))
    # At most 2 * limit + 2 rows a source from here. A source's ends are among its tops too; its other rows only fill up fewer chapters than limit.
    both = ends.unionByName(rest).groupBy("source", "chapter", "sentence", "score", "o").agg(F.min("rank").alias("rank"))
    out = both.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", *best)))
    return out.where(F.col("place") <= limit).select("source", "chapter", "sentence", "score")


def summary(found: DataFrame, paragraphs: DataFrame, chapter: str, position: str, text: str) -> DataFrame:
    """One row for each candidate: occurrences in texts that have it, chapters, counts by chapter, first and last chapter, evidence, type."""
    return summarized(occurrences(found, paragraphs, chapter, position, text))


def summarized(o: DataFrame) -> DataFrame:
    """mined() or occurrences() -> one row for each candidate, as summary() gives."""
    by = o.groupBy("source", "chapter").agg(F.sum("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("chapter", "n")))
    counts = by.groupBy("source").agg(F.sum("n").alias("occurrences"), ordered.alias("by_chapter"), F.min("chapter").alias("first_seen"), F.max("chapter").alias("last_seen"))
    evidence = best_evidence(o).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chapter", (-F.col("score")).alias("rank"), "sentence"))).alias("evidence"))
    out = counts.join(evidence, "source", "left")
    kind = possible_type(F.col("source"), F.array_join(F.transform("evidence", lambda x: x["sentence"]), "\n"))
    return out.withColumn("possible_type", kind).where(source_problem(F.col("source")).isNull() & F.col("possible_type").isNotNull())


def merge_counts(old: DataFrame, new: DataFrame, add_rest: bool = True) -> DataFrame:
    """old and new (source, chapter, n; a null chapter: occurrences without one) -> the same, with the larger count of each chapter. The rest without a
    chapter is added up, or (add_rest false) the larger stays."""
    both = old.unionByName(new).groupBy("source", "chapter")
    rest = F.sum("n") if add_rest else F.max("n")
    return both.agg(F.when(F.col("chapter").isNull(), rest).otherwise(F.max("n")).alias("n"))


def spread_legacy(rows: DataFrame) -> DataFrame:
    """(source, occurrences, chapters array) -> (source, chapter, n): the count spread evenly, the remainder on the first chapters, 1 at least."""
    e = rows.select("source", F.greatest("occurrences", F.lit(1)).alias("occurrences"), F.size("chapters").alias("k"), F.posexplode(F.array_sort(F.array_distinct("chapters"))).alias("i", "chapter"))
    n = F.floor(F.col("occurrences") / F.col("k")) + (F.col("i") < F.col("occurrences") % F.col("k")).cast("int")
    return e.select("source", "chapter", F.greatest(n, F.lit(1)).cast("long").alias("n"))


def rejected(old: DataFrame, new: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(source, reason) of both, the new reason first, at most 300 characters, without confirmed sources."""
    both = old.withColumn("t_", F.lit(0)).unionByName(new.withColumn("t_", F.lit(1))).where(X.has_text(F.col("source")))
    last = both.groupBy("source").agg(F.max_by(F.substring("reason", 1, 300), "t_").alias("reason"))
    return last.join(confirmed.select("source"), "source", "left_anti")


def contradictory(outcomes: DataFrame) -> DataFrame:
    """Sources in more than one outcome: outcomes (source, outcome)."""
    return outcomes.groupBy("source").agg(F.countDistinct("outcome").alias("n")).where("n > 1").select("source")


def batches(ordered: DataFrame, keys: list[str], order: str, payload: str, limit: int = 32_000) -> DataFrame:
    """Next-fit batches of candidates by the length of their JSON; one that is too long stands alone. A fold over sizes, JVM-side."""
    a = ordered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.length(payload).cast("long").alias("c_")))).alias("s"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["c"] > 0) & (acc["c"] + x["c_"] > limit)
        g = acc["g"] + full.cast("int")
        return F.struct(g.alias("g"), F.when(full, x["c_"]).otherwise(acc["c"] + x["c_"]).alias("c"), F.concat(acc["out"], F.array(g)).alias("out"))

    z = F.arrays_zip(F.transform("s", lambda x: x[order]).alias(order), F.aggregate("s", zero, step)["out"].alias("batch"))
    return ordered.join(a.select(*keys, F.explode(z).alias("z")).select(*keys, f"z.{order}", "z.batch"), [*keys, order])


def needs_resolving(new: DataFrame, old: DataFrame) -> DataFrame:
    """Candidates with more occurrences or other evidence than before, a type known only now, or an error on other input. new, old (source, occurrences,
    evidence array, possible_type, last_error, input_hash)."""
    o = old.select("source", *[F.col(c).alias(f"o_{c}") for c in ("occurrences", "evidence", "possible_type", "last_error", "input_hash")], F.lit(True).alias("known"))
    j = new.join(o, "source", "left")
    fresh = F.size(F.array_except("evidence", F.coalesce("o_evidence", F.array().cast("array<string>")))) > 0
    typed = (F.col("o_possible_type") == "unknown") & (F.col("possible_type") != "unknown")
    failed = F.col("o_last_error").isNotNull() & ~F.col("input_hash").eqNullSafe(F.col("o_input_hash"))
    return j.where(F.col("known").isNull() | (F.col("occurrences") > F.coalesce("o_occurrences", F.lit(0))) | fresh | typed | failed).select(new.columns)


def merge_frames(parts: Iterator[DataFrame]) -> DataFrame:
    """Union of candidates by name, once each."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def filter_reason(source: Column, kind: Column, evidence: Column) -> Column:
    """Why a candidate isn't worth a question, or null: a source that can't be a term, or one without a known type that neither its form nor its evidence suggests."""
    known = F.coalesce(kind.isin("character", "location", "institution", "book_title", "term"), F.lit(False))
    return F.coalesce(source_problem(source), F.when(~known & possible_type(source, evidence).isNull(), "no independent identity or reusable-term signal"))


def by_frequency(rows: DataFrame) -> DataFrame:
    """Candidates (source, occurrences, ...) the most frequent first, then by source."""
    return rows.orderBy(F.col("occurrences").desc(), "source")


def without_decided(rows: DataFrame, locked: DataFrame, rejected_: DataFrame) -> DataFrame:
    """Candidates that are neither a surface of the dictionary (surface) nor rejected (source)."""
    return rows.join(locked.select(F.col("surface").alias("source")), "source", "left_anti").join(rejected_.select("source"), "source", "left_anti")


def widened(entries: DataFrame, relevant: DataFrame, batch: DataFrame) -> DataFrame:
    """relevant entries, and the characters whose first character a candidate of the batch (source) starts with: an equality join on that character."""
    heads = batch.select(F.substring("source", 1, 1).alias("head_")).distinct()
    more = entries.where("type = 'character'").join(relevant.select("source"), "source", "left_anti")
    more = more.join(heads, F.substring("source", 1, 1) == F.col("head_"), "left_semi")
    return relevant.unionByName(more.select(relevant.columns))


EVIDENCE = "array<struct<chapter:long,text:string>>"
UNRESOLVED = (
    f"source string, possible_type string, reason string, evidence {EVIDENCE}, first_seen_chapter long, last_seen_chapter long, chapters array<long>, occurrences long, "
    "by_chapter map<long,long>, resolve_attempts long, last_error string, last_attempt_input_hash string"
)


def _total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)


def normalized_unresolved(records: DataFrame) -> DataFrame:
    """Unresolved candidates as older versions kept them -> UNRESOLVED, a row each, those not worth a question left out.

    records: UNRESOLVED with evidence as array<struct<chapter, text>>; where a chapter of evidence is null, it is the chapter of its place among chapters (the last for later
    ones), else the first seen. Without counts by chapter, the occurrences (or as many as there is evidence, one at least) are spread over the chapters evenly,
    the remainder on the first ones, else they are the last chapter's.
    """
    empty = F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<long>"))
    r = records.withColumns({"chapters": F.array_sort(F.array_distinct(F.coalesce("chapters", F.array().cast("array<long>")))), "by_chapter": F.coalesce("by_chapter", empty), "evidence": F.coalesce("evidence", F.array().cast(EVIDENCE))})
    k = F.size("chapters")
    r = r.withColumns({"first_seen_chapter": F.coalesce("first_seen_chapter", F.get("chapters", F.lit(0))), "last_seen_chapter": F.coalesce("last_seen_chapter", F.get("chapters", k - 1))})
    placed = F.transform("evidence", lambda e, i: F.struct(F.coalesce(e["chapter"], F.when(F.size("chapters") > 0, F.get("chapters", F.least(i, F.size("chapters") - 1))).otherwise(F.col("first_seen_chapter"))).alias("chapter"), e["text"].alias("text")))
    r = r.withColumn("evidence", F.array_distinct(F.filter(placed, lambda e: X.has_text(e["text"]))))
    n = F.greatest(F.coalesce(F.col("occurrences"), F.nullif(F.size("evidence"), F.lit(0)), F.lit(1)).cast("long"), F.lit(1).cast("long"))
    each = F.transform("chapters", lambda c, i: F.greatest(F.floor(n / F.size("chapters")) + (i < n % F.size("chapters")).cast("long"), F.lit(1)).cast("long"))
    counts = F.when(F.size(F.map_keys("by_chapter")) > 0, F.transform_values("by_chapter", lambda k_, v: F.greatest(v, F.lit(0).cast("long")))).when(k > 0, F.map_from_arrays("chapters", each))
    counts = F.coalesce(counts, F.when(F.col("last_seen_chapter").isNotNull(), F.map_from_arrays(F.array("last_seen_chapter"), F.array(n))), empty)
    r = r.withColumn("n_", n).withColumn("by_chapter", counts)
    r = r.withColumn("occurrences", F.coalesce(F.nullif(_total(F.col("by_chapter")), F.lit(0).cast("long")), F.col("n_"))).drop("n_")
    r = r.withColumn("possible_type", F.when(F.col("possible_type").isin("character", "location", "institution", "book_title", "term", "unknown"), F.col("possible_type")))
    r = r.withColumns({"reason": F.coalesce(F.nullif("reason", F.lit("")), F.lit("insufficient evidence")), "resolve_attempts": F.greatest(F.coalesce("resolve_attempts", F.lit(0).cast("long")), F.lit(0).cast("long"))})
    r = _typed(r)
    texts = F.array_join(F.transform("evidence", lambda e: e["text"]), "\n")
    return r.where(filter_reason(F.col("source"), F.col("possible_type"), texts).isNull()).select([c.split()[0] for c in UNRESOLVED.split(", ")])


def _typed(rows: DataFrame) -> DataFrame:
    """rows with the type that form and evidence suggest, unless that is unknown or none; else the one they had, else unknown."""
    texts = F.array_join(F.transform("evidence", lambda e: e["text"]), "\n")
    inferred = possible_type(F.col("source"), texts)
    return rows.withColumn("possible_type", F.when(inferred != "unknown", inferred).otherwise(F.coalesce("possible_type", inferred, F.lit("unknown"))))


def merged_unresolved(old: DataFrame, new: DataFrame, add_rest: bool = True, limit: int = 5) -> DataFrame:
    """old and new UNRESOLVED rows, one for each source on each side -> merged: a full join by source.

    Counts by chapter: the larger; what either has beyond its chapters is added up (add_rest) or the larger stays. Evidence: the best of both. A new type counts unless it
    is unknown, and what form and evidence suggest goes before both. Reason, error and input hash: the new one's, else the old one's. Attempts: the larger.
    """
    names = [c.split()[0] for c in UNRESOLVED.split(", ")]
    side = lambda d, k: d.select("source", F.struct(*[n for n in names if n != "source"]).alias(k))
    j = side(old, "o").join(side(new, "n"), "source", "full")
    empty = F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<long>"))
    of = lambda k, f, none: F.coalesce(F.col(f"{k}.{f}"), none)
    zero = F.lit(0).cast("long")
    a, b = of("o", "by_chapter", empty), of("n", "by_chapter", empty)
    counts = F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))
    rest = lambda k, m: F.greatest(zero, of(k, "occurrences", zero) - _total(m))
    beyond = rest("o", a) + rest("n", b) if add_rest else F.greatest(rest("o", a), rest("n", b))
    none = F.array().cast("array<long>")
    chapters = F.array_sort(F.array_union(F.array_union(F.map_keys(counts), of("o", "chapters", none)), of("n", "chapters", none)))
    kind = F.when(F.coalesce(F.col("n.possible_type"), F.lit("unknown")) != "unknown", F.col("n.possible_type")).otherwise(F.coalesce("o.possible_type", "n.possible_type"))
    later = lambda f: F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")).alias(f)
    out = j.select(
        "source", kind.alias("possible_type"), F.coalesce("n.reason", "o.reason", F.lit("insufficient evidence")).alias("reason"),
        F.array_distinct(F.concat(of("o", "evidence", F.array().cast(EVIDENCE)), of("n", "evidence", F.array().cast(EVIDENCE)))).alias("evidence"),
        F.least("o.first_seen_chapter", F.get(chapters, F.lit(0))).alias("first_seen_chapter"), F.greatest("o.last_seen_chapter", F.get(chapters, F.size(chapters) - 1)).alias("last_seen_chapter"),
        chapters.alias("chapters"), (_total(counts) + beyond).alias("occurrences"), counts.alias("by_chapter"), F.greatest(of("o", "resolve_attempts", zero), of("n", "resolve_attempts", zero)).alias("resolve_attempts"),
        later("last_error"), later("last_attempt_input_hash"),
    )
    e = out.select("source", F.posexplode("evidence").alias("position", "e")).select("source", F.col("e.chapter").alias("chapter"), F.col("e.text").alias("sentence"), "position")
    kept = best_evidence(e, limit=limit)
    kept = kept.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("chapter").isNull().alias("none"), "chapter", (-F.col("score")).alias("rank"), F.col("sentence").alias("text")))).alias("kept"))
    out = out.join(kept, "source", "left").withColumn("evidence", F.coalesce(F.transform("kept", lambda x: F.struct(x["chapter"].alias("chapter"), x["text"].alias("text"))), F.array().cast(EVIDENCE)))
    return _typed(out).select(names)
