"""Fields of a specification's articles. texts: doc, article, text; rows: doc, article, table_idx, row_idx, cells (array of strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridrecon.functions import text

TABLE = ["doc", "article", "table_idx"]
# Patterns of the text fields of articles 2 and 3, whether they say 有 or 無, and the field's name.
ARTICLE_2 = {
    "全体工期": r"全体工期\s+(\d+)", "うち余裕期間": r"うち余裕期間\s*(\d*)\s*日間", "うち実工期": r"うち実工期\s*(\d*)\s*日間",
    "余裕期間の設定_対象の有無": r"3\s+余裕期間の設定.*?対象の有無\s+([^\n]+)", "週休２日工事_対象の有無": r"4\s+週休２日工事.*?対象の有無\s+([^\n]+)",
    "週休２日工事_分類": r"4\s+週休２日工事.*?\s*（(.*?)）", "熱中症予防対策に係る工期の延長_対象の有無": r"11\s+熱中症予防対策.*?対象の有無\s+([^\n]+)",
}
ARTICLE_3 = {
    "工事現場の現場環境改善及び地域連携_対象の有無": r"4\s+工事現場の現場環境改善.*?対象の有無\s+([^\n]+)", "ＩＣＴ活用工事_対象の有無": r"15\s+ＩＣＴ活用工事.*?対象の有無\s+([^\n]+)",
    "ＩＣＴ活用工事_区分": r"15\s+ＩＣＴ活用工事.*?\nＩＣＴ活用工事（(.*?)）",
    "１日未満で完了する小規模作業の積算_対象の有無": r"16\s+１日未満で完了する小規模作業の積算.*?対象の有無\s+([^\n]+)",
    "熱中症対策に資する現場管理費補_対象の有無": r"17\s+熱中症対策に資する現場管理費補.*?対象の有無\s+([^\n]+)",
}
# Ticked tables of article 4: name, words of the header row, words anywhere, names and places of the columns.
TICKED = {
    "アスファルト混合物": (("アスファルト合材名", "使用箇所"), (), {"材料名": 2, "使用箇所": 3}), "上記以外の使用アスファルト合材の有無": ((), ("上記以外の使用アスファルト合材の有無",), {"材料名": 1, "使用箇所": 2}),
    "石材類": (("石材類",), (), {"材料名": 1, "規格": 2, "適用箇所": 3}), "上記以外の使用材料の有無": ((), ("上記以外の使用材料の有無",), {"材料名": 1, "規格": 2, "適用箇所": 3}),
    "鉄筋": (("鉄筋",), (), {"材料名": 1, "規格": 2, "適用箇所": 3}),
}
# Plain tables by the words of their header row: section, article, columns, leading columns that must not be blank.
LISTED = {
    "建設副産物": ("第11条", ("副産物名", "搬入再資源化施設名", "搬入場所", "備考"), 2, 3), "建設廃棄物": ("第11条", ("廃棄物名", "受入施設名", "受入場所", "備考"), 2, 3),
    "周辺環境影響調査": ("第13条", ("調査項目", "採取地点", "採取回数", "備考"), 4, 2), "現場発生品": ("第14条", ("種類", "数量", "保管・仮置場所"), 3, 3),
    "その他の特記事項": ("第14条", ("特記事項", "特記事項の内容"), 2, 2),
}
# Conditions of article 7 with the labels of the lines below, and the columns of its guards' table.
CONDITIONS = {
    "水替・流入防止施設": ("水替・流入防止施設設置の公害防止対策の有無", ("施 設 内 容", "設 置 期 間")), "濁水・湧水等の処理条件": ("濁水・湧水等の処理条件の有無", ("処 理 施 設", "処 理 条 件 等")),
    "事業損失防止": ("事業損失防止のための事前・事後調査の有無", ("調 査 項 目", "調 査 時 期", "調 査 方 法", "調 査 範 囲")),
}
POLLUTION = "排出ガス防止のための施工方法等の制限の有無"
GUARDS = {"配置場所": "配置場所", "配置員数": "配置員数", "編制": "編制|編成", "総配置員数": "総配置員数|総配置員數|総員数", "昼夜別": "昼夜別", "交代要員の有無": "交代要員.*有無"}
TEMPORARY, PAIRED = ("工種", "種別", "細別", "単位", "数量", "備考"), ("仮設備の引渡し・引継ぎ", "仮設備の構造・施工方法の指定", "仮設備の設計条件の指定")


def text_fields(texts: DataFrame, patterns: dict[str, str], else_no: bool = False) -> DataFrame:
    """doc and a column for each pattern's first group, null if not found; fields of 対象の有無 are 有, 無 or (not else_no) null."""

    def one(name: str, pattern: str) -> Column:
        x = F.trim(text.field(F.col("text"), f"(?U){pattern}"))
        if "対象の有無" in name:
            x = F.when(x.isNull(), None).when(F.contains(x, F.lit("有")) & ((x != "無") if else_no else F.lit(True)), "有").when(F.lit(else_no) | F.contains(x, F.lit("無")), "無")
        return x.alias(name)

    return texts.select("doc", *(one(k, p) for k, p in patterns.items()))


def article_2(texts: DataFrame) -> DataFrame:
    return text_fields(texts, ARTICLE_2)


def article_3(texts: DataFrame) -> DataFrame:
    return text_fields(texts, ARTICLE_3, else_no=True)


def _line(c: Column, by: str = "") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\\n", by)


def _words(cells: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(cells, lambda c: _line(c)), ""), " ", "")


def _of_table(c: Column) -> Column:
    """c of all rows of a table joined, for each of its rows."""
    return F.array_join(F.collect_list(c).over(W.partitionBy(*TABLE)), "")


def ticked(rows: DataFrame) -> DataFrame:
    """doc, section, table_idx, row_idx, fields: rows of the material tables of article 4 whose first cell is ticked (■).

    Which table is which is told by words of its header row or of any row.
    """
    df = rows.withColumn("_head", F.first(_words(F.col("cells"))).over(W.partitionBy(*TABLE).orderBy("row_idx"))).withColumn("_all", _of_table(_words(F.col("cells"))))
    sections = []
    for name, (head, anywhere, places) in TICKED.items():
        hit = F.lit(True)
        for w in head:
            hit = hit & F.contains("_head", F.lit(w))
        for w in anywhere:
            hit = hit & F.contains("_all", F.lit(w))
        if name == "石材類":
            hit = hit | (F.contains("_head", F.lit("材料名")) & F.contains("_head", F.lit("適用箇所")))
        wide = F.size("cells") > max(places.values())
        fields = F.create_map(*(x for k, i in places.items() for x in (F.lit(k), _line(F.get("cells", F.lit(i)), "" if "アスファルト" in name else " "))))
        sections.append(F.when(hit & wide & ((F.col("row_idx") > 0) | F.lit(bool(anywhere))), F.struct(F.lit(name).alias("section"), fields.alias("fields"))))
    df = df.where(F.contains(F.get("cells", F.lit(0)), F.lit("■")))
    return df.select("doc", F.explode(F.filter(F.array(*sections), lambda s: s.isNotNull())).alias("x"), "table_idx", "row_idx").select("doc", "x.section", "table_idx", "row_idx", "x.fields")


def concrete(rows: DataFrame) -> DataFrame:
    """doc, table_idx, row_idx and the ticked concrete rows: the cement is the heading of the ticked of two columns.

    The headings stand in the first row with BB or N in a cell; data rows lie below it.
    """
    df = rows.withColumn("_all", _of_table(_words(F.col("cells")))).where(F.contains("_all", F.lit("適用工種")) & F.contains("_all", F.lit("セメント種類")))
    w = W.partitionBy(*TABLE).orderBy("row_idx")
    kinds = F.exists("cells", lambda c: F.contains(c, F.lit("BB")) | F.contains(c, F.lit("N")))
    df = df.withColumn("_kinds", F.first(F.when(kinds, F.col("cells")), ignorenulls=True).over(w)).withColumn("_below", F.coalesce(F.max(F.when(kinds, F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    df = df.where((F.col("_below") == 1) & (F.size("cells") >= 8) & F.contains(F.get("cells", F.lit(0)), F.lit("■")))
    tick = lambda i: F.contains(_line(F.get("cells", F.lit(i))), F.lit("■"))
    kind = F.when(tick(3), F.get("_kinds", F.lit(3))).when(tick(4), F.get("_kinds", F.lit(4)))
    at = lambda i: _line(F.get("cells", F.lit(i)))
    return df.select("doc", "table_idx", "row_idx", F.trim(F.coalesce(kind, F.lit(""))).alias("セメント種類"), at(5).alias("規格"), at(6).alias("最大水セメント比"), at(7).alias("最小セメント使用量"))


def other_materials(rows: DataFrame) -> DataFrame:
    """doc, row_idx and four columns of the first table at or after the one that asks for other materials whose header has name and form."""
    w = W.partitionBy(*TABLE).orderBy("row_idx")
    df = rows.withColumn("_ask", F.contains(_of_table(F.array_join("cells", "")), F.lit("その他の使用材料の有無"))).withColumn("_head", F.first(F.transform("cells", lambda c: F.trim(_line(c)))).over(w))
    of_doc = W.partitionBy("doc")
    df = df.withColumn("_from", F.min(F.when(F.col("_ask"), F.col("table_idx"))).over(of_doc))
    fits = F.array_contains("_head", F.lit("材料名")) & F.array_contains("_head", F.lit("規格・寸法・材質")) & (F.col("table_idx") >= F.col("_from"))
    df = df.withColumn("_table", F.min(F.when(fits, F.col("table_idx"))).over(of_doc)).where("table_idx = _table and row_idx > 0")
    df = df.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return df.select("doc", "row_idx", *(F.trim(_line(F.get("cells", F.lit(i)), " ")).alias(k) for i, k in enumerate(("材料名", "規格・寸法・材質", "適用工種", "備考"))))


def conditions(texts: DataFrame) -> DataFrame:
    """doc, condition, fields of article 7: each condition that holds (有), with what the labelled lines right below it say.

    Each label has its own line below; a condition none of whose lines says anything is left out. The last mention speaks.
    """
    lines = texts.select("doc", F.split("text", "\\n").alias("lines"))
    df = lines.select("doc", "lines", F.posexplode("lines").alias("i", "line")).where(F.contains("line", F.lit("有")))
    found = [F.when(F.contains("line", F.lit(POLLUTION)), F.struct(F.lit("公害防止のための制限").alias("condition"), F.create_map(F.lit("内容"), F.lit(POLLUTION)).alias("fields")))]
    for name, (asked, labels) in CONDITIONS.items():
        pairs = []
        for k, label in enumerate(labels, 1):
            below = F.get("lines", F.col("i") + k)
            value = F.trim(F.replace(below, F.lit(label), F.lit("")))
            pairs += [F.lit(label.replace(" ", "")), F.when(F.contains(below, F.lit(label)) & (value != ""), value)]
        fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
        found.append(F.when(F.contains("line", F.lit(asked)) & (F.size(fields) > 0), F.struct(F.lit(name).alias("condition"), fields.alias("fields"))))
    df = df.select("doc", "i", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    last = F.row_number().over(W.partitionBy("doc", "x.condition").orderBy(F.col("i").desc()))
    return df.withColumn("n", last).where("n = 1").select("doc", "x.condition", "x.fields")


def guards(rows: DataFrame) -> DataFrame:
    """doc, row_idx, the six columns and the route of the traffic guards of article 8, from the first table whose first row has all six headings.

    A row with only a place takes the rest from the row below; blanks below a value repeat it; the route is the place's second line.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s", "")
    place = lambda p: F.array_min(F.filter(F.transform("cells", lambda c, i: F.when((F.length(bare(c)) <= 10) & bare(c).rlike(p), i)), lambda i: i.isNotNull()))
    head = rows.where("row_idx = 0").select(*TABLE, *(place(("^(?:" if k in ("配置場所", "配置員数") else "(?:") + p + ")").alias(f"_{i}") for i, (k, p) in enumerate(GUARDS.items())))
    for i in range(len(GUARDS)):
        head = head.where(F.col(f"_{i}").isNotNull())
    first = head.withColumn("_t", F.min("table_idx").over(W.partitionBy("doc"))).where("table_idx = _t").drop("_t")
    df = rows.join(first, TABLE).where((F.col("row_idx") > 0) & F.exists("cells", lambda c: bare(c) != ""))
    joined = bare(F.array_join("cells", ""))
    repeated = F.lit(True)
    for k in ("配置場所", "配置員数", "編", "総", "昼夜", "交代"):
        repeated = repeated & F.contains(joined, F.lit(k))
    df = df.where(~repeated)
    for i, k in enumerate(GUARDS):
        df = df.withColumn(k, F.nullif(F.trim(F.get("cells", F.col(f"_{i}"))), F.lit("")))
    w = W.partitionBy("doc").orderBy("row_idx")
    first_key, *others = GUARDS
    lone = F.col(first_key).isNotNull()
    for k in others:
        lone = lone & F.col(k).isNull()
    df = df.withColumn("_lone", lone)
    # a row that is taken in can't take in the next: in a run of lone rows every other one does
    df = df.withColumn("_run", F.sum((~F.col("_lone")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("_takes", F.col("_lone") & (F.row_number().over(W.partitionBy("doc", "_run").orderBy("row_idx")) % 2 == 1))
    nxt = {k: F.coalesce(F.when(F.col("_takes"), F.lead(k).over(w)), F.col(k)) for k in others}
    df = df.withColumns({**nxt, "_gone": F.coalesce(F.lag("_takes").over(w), F.lit(False))}).where("not _gone")
    df = df.withColumns({k: F.last(k, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) for k in GUARDS})
    lines = F.split(F.col(first_key), "\\n")
    route = F.trim(F.coalesce(F.get(lines, F.lit(1)), F.get(lines, F.lit(0))))
    return df.select("doc", "row_idx", *(F.coalesce(k, F.lit("")).alias(k) for k in GUARDS), F.coalesce(route, F.lit("")).alias("路線名"))


def temporary_works(rows: DataFrame) -> DataFrame:
    """doc, section (任意仮設 of the first, 指定仮設 of the second table with the six headings), row_idx and the six columns of article 10."""
    head = rows.where("row_idx = 0").withColumn("h", F.array_join(F.transform("cells", lambda c: _line(c)), ""))
    for k in TEMPORARY:
        head = head.where(F.contains("h", F.lit(k)))
    n = F.row_number().over(W.partitionBy("doc").orderBy("table_idx"))
    head = head.select(*TABLE, n.alias("n")).where("n <= 2")
    df = rows.join(head, TABLE).where((F.col("row_idx") > 0) & F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return df.select("doc", F.when(F.col("n") == 1, "任意仮設").otherwise("指定仮設").alias("section"), "row_idx", *(F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(k) for i, k in enumerate(TEMPORARY)))


def paired_works(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, item, answer (無, 有 or null within 75 characters of the item's name), details: the k-th two-column table for the k-th item."""
    w = W.partitionBy(*TABLE)
    two = rows.withColumn("_two", F.first(F.size("cells")).over(w.orderBy("row_idx")) == 2).withColumn("_asks", F.contains(_of_table(F.array_join("cells", "")), F.lit("対象の有無")))
    two = two.where("_two and not _asks").withColumn("k", F.dense_rank().over(W.partitionBy("doc").orderBy("table_idx")))
    full = (F.size("cells") == 2) & (F.trim(F.get("cells", F.lit(0))) != "") & (F.trim(F.get("cells", F.lit(1))) != "")
    details = two.where(full).groupBy("doc", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.transform("cells", F.trim).alias("c")))), lambda x: x["c"]).alias("details"))
    item = F.posexplode(F.array(*map(F.lit, PAIRED))).alias("k", "item")
    asked = texts.select("doc", "text", item).withColumn("k", F.col("k") + 1).withColumn("at", F.expr("instr(text, item)"))
    near = F.when(F.col("at") > 0, F.substring("text", F.col("at"), F.lit(75)))
    answer = F.when(F.contains(near, F.lit("無")), "無").when(F.contains(near, F.lit("有")), "有")
    return asked.select("doc", "k", "item", answer.alias("answer")).join(details, ["doc", "k"], "left").drop("k")


def listed(rows: DataFrame, section: str) -> DataFrame:
    """doc, row_idx and the columns of one of the plain tables (LISTED): the first table with its headings that has rows whose leading cells are filled."""
    article, names, told, leading = LISTED[section]
    head = rows.where((F.col("row_idx") == 0) & (F.col("article") == article)).withColumn("h", _words(F.col("cells")))
    for k in names[:told]:
        head = head.where(F.contains("h", F.lit(k)))
    filled = F.size("cells") >= leading
    for i in range(leading):
        filled = filled & F.coalesce(F.trim(F.get("cells", F.lit(i))) != "", F.lit(True))  # a missing cell counts as text
    df = rows.join(head.select(*TABLE), TABLE).where((F.col("row_idx") > 0) & filled)
    df = df.withColumn("_t", F.min("table_idx").over(W.partitionBy("doc"))).where("table_idx = _t")
    return df.select("doc", "row_idx", *(F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(k) for i, k in enumerate(names)))


def article_14(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, labour (有 or 無), detail (the first ○ line of the first table that has one), scattered (有 or 無), method (its line, if 有)."""
    t = F.col("text")
    asked = lambda name: text.field(t, f"(?U){name}.*?対象の有無\\s*([^\\n]+)")
    yes = lambda x: F.when(F.contains(F.coalesce(x, F.lit("")), F.lit("有")), "有").otherwise("無")
    circle = rows.where((F.size("cells") == 2) & (F.trim(F.get("cells", F.lit(0))) == "○"))
    first = circle.groupBy("doc").agg(F.min(F.struct("table_idx", "row_idx", F.trim(_line(F.get("cells", F.lit(1)), " ")).alias("d"))).alias("x")).select("doc", F.nullif(F.col("x.d"), F.lit("")).alias("detail"))
    scattered = yes(asked("施工箇所が点在する工事の積算方法"))
    method = F.when(scattered == "有", F.trim(text.field(t, "(?U)施工箇所が点在する工事の積算方法\\s*([^\\n]+)\\n\\s*対象の有無")))
    out = texts.select("doc", yes(asked("労働者確保に要する間接費の実績変更")).alias("labour"), scattered.alias("scattered"), method.alias("method"))
    return out.join(first, "doc", "left")


def survey_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The survey table of article 13, only where the text says 有."""
    held = texts.where(F.contains(F.coalesce(text.field(F.col("text"), "(?U)周辺環境影響調査.*?対象の有無\\s*([^\\n]+)"), F.lit("")), F.lit("有"))).select("doc").distinct()
    return listed(rows, "周辺環境影響調査").join(held, "doc", "left_semi")


def all_sections(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, section, json: everything found in the articles, one row per document and section or table row."""
    of = lambda *a: texts.where(F.col("article").isin(*a))
    has = lambda *a: rows.where(F.col("article").isin(*a))
    parts = {
        "第2条": article_2(of("第2条")), "第3条": article_3(of("第3条")), "第4条": ticked(has("第4条")), "第4条 コンクリート": concrete(has("第4条")), "第4条 その他": other_materials(has("第4条")),
        "第7条": conditions(of("第7条")), "第8条": guards(has("第8条")), "第10条": temporary_works(has("第10条")), "第10条 仮設備": paired_works(of("第10条"), has("第10条")),
        "第11条 副産物": listed(rows, "建設副産物"), "第11条 廃棄物": listed(rows, "建設廃棄物"), "第13条": survey_rows(of("第13条"), rows),
        "第14条": article_14(of("第14条"), has("第14条")), "第14条 現場発生品": listed(rows, "現場発生品"), "第14条 特記事項": listed(rows, "その他の特記事項"),
    }
    out = None
    for name, df in parts.items():
        one = df.select("doc", F.lit(name).alias("section"), F.to_json(F.struct(*(c for c in df.columns if c != "doc"))).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out
