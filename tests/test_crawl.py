"""Robots rules, retry policy, cache and traversal."""

import random
import time
from collections import deque
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from contentgrade.functions import urls as U
from contentgrade.operators.attempts import cached_fetch, final_attempts, number_attempts
from contentgrade.operators.frontier import _bucketed, crawl_frontier, page_budget
from contentgrade.operators.robots import apply_rules, effective_delay, index_rules, robots_allowed
from contentgrade.operators.skew import lookup, nth_smallest, numbered, salted_lookup
from contentgrade.session import shared_dir
from contentgrade.sources.robots import agent_rules, latest_robots, parse_robots, robots_files, robots_rules

BODIES = {
    "star.example": "User-agent: *\nAllow: /a/ok\nDisallow: /a/\nCrawl-delay: 3\n",
    "own.example": "User-agent: *\nDisallow: /\n\nUser-agent: GradeBot\nDisallow: /x # no\nDisallow: /%7Ejoe\n",
    "first.example": "User-agent: gradebot\nUser-agent: other\nDisallow: /b\nAllow: /b/c\n\n\nUser-agent: grade\nDisallow: /\n",
    "blank.example": "User-agent: *\n\nDisallow: /a\n",
    "split.example": "User-agent: *\nDisallow: /a\n\nDisallow: /b\nSitemap: https://s/1\nsitemap: https://s/2\n",
    "empty.example": "User-agent: *\nDisallow:\nDisallow: /a\n",
    "query.example": "User-Agent: *\nDisallow: /s?q=\nDisallow: /é\n",
    "delay.example": "User-agent: gradebot\nCrawl-delay: x\nDisallow: /q\n\nUser-agent: *\nCrawl-delay: 7\nDisallow: /a\n",
    "crlf.example": "User-agent: *\r\nDisallow: /a\r\n\r\nUser-agent: gradebot\r\nAllow: /\r\n",
    "nonsense.example": "hello\nDisallow: /a\n",
    "two.example": "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n",
    "blankish.example": "User-agent: *\n  \nDisallow: /a\n",
}
PATHS = ["", "/", "/a", "/a/ok/1", "/a/x", "/b", "/b/c", "/x/1", "/~joe/", "/%7ejoe", "/s?q=1", "/s?p=1", "/é/1", "/%C3%A9", "/q"]
AGENTS = ["GradeBot/1.0 (+info)", "somebot", "*"]


@pytest.fixture(scope="module")
def robots(spark):
    rows = [(host, 200, body) for host, body in BODIES.items()]
    rows += [("gone.example", 404, "User-agent: *\nDisallow: /\n"), ("void.example", 200, "  \n")]
    return spark.createDataFrame(rows, "host string, status_code int, body string")


def test_rules_match_the_standard_parser(spark, robots):
    groups, _ = parse_robots(robots)
    urls = [(f"https://{h}{p}",) for h in [*BODIES, "gone.example", "void.example", "new.example"] for p in PATHS]
    frame = spark.createDataFrame(urls, "url string")
    for agent in AGENTS:
        for row in robots_allowed(frame, groups, agent).collect():
            host = row["url"].split("/")[2]
            parser = RobotFileParser()
            parser.parse(BODIES.get(host, "").splitlines())
            assert row["allowed"] == parser.can_fetch(agent, row["url"]), (agent, row["url"])


def test_delays_and_sitemaps(spark, robots):
    groups, sitemaps = parse_robots(robots)
    found = {r["host"]: r["sitemaps"] for r in sitemaps.collect()}
    assert found == {"split.example": ["https://s/1", "https://s/2"]}
    for agent in AGENTS:
        delays = {r["host"]: r["crawl_delay"] for r in agent_rules(groups, agent).collect()}
        for host, body in BODIES.items():
            parser = RobotFileParser()
            parser.parse(body.splitlines())
            assert delays.get(host) == (parser.crawl_delay(agent) or parser.crawl_delay("*")), (agent, host)
    hosts = robots.select("host")
    delay = {r["host"]: r["delay"] for r in effective_delay(hosts, groups, "x", 5.0).collect()}
    assert delay["star.example"] == 5.0 and delay["delay.example"] == 7.0 and delay["gone.example"] == 5.0
    assert robots_rules(groups).filter("host = 'star.example'").count() == 2


def test_files_are_read_within_their_rows(spark, robots):
    files = robots_files(robots)
    for table in (files, *parse_robots(robots), agent_rules(files, "somebot")):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    groups, _ = parse_robots(robots)
    for agent in AGENTS:
        narrow, shuffled = (sorted(map(str, agent_rules(t, agent).collect())) for t in (files, groups))
        assert narrow == shuffled


def test_bodies_of_random_lines_match_the_standard_parser(spark):
    r = random.Random(8)
    lines = ["User-agent: *", "User-agent: gradebot", "user-agent : other", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /",
             "Crawl-delay: 4", "Crawl-delay: no", "", "", "# note", "Sitemap: https://s/1", "Request-rate: 1/5", "odd"]
    bodies = {f"h{i}.example": r.choice(["\n", "\r\n", "\r"]).join(r.choices(lines, k=r.randrange(1, 14))) for i in range(150)}
    files = robots_files(spark.createDataFrame([(h, 200, b) for h, b in bodies.items()], "host string, status_code int, body string"))
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in bodies for p in ("/", "/a", "/a/b", "/c")], "url string")
    for agent in AGENTS[:2]:
        for row in robots_allowed(urls, files, agent).collect():
            parser = RobotFileParser()
            parser.parse(bodies[row["url"].split("/")[2]].splitlines())
            assert row["allowed"] == parser.can_fetch(agent, row["url"]), (agent, row["url"])


def test_a_long_file_and_the_latest_of_several(spark):
    long = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}/" for i in range(20_000)) + "\n\nUser-agent: x\nDisallow: /\n"
    rows = [("a", 200, "User-agent: *\nDisallow: /old\n", 1), ("a", 200, long, 5), ("a", 404, "", 3), ("b", 200, long, 1), ("b", 500, "", 2)]
    files = robots_files(latest_robots(spark.createDataFrame(rows, "host string, status_code int, body string, fetched_at int")))
    groups = files.select("host", F.inline("groups")).collect()
    assert [(g["host"], g["group_no"], len(g["rules"]), g["rules"][-1]["path"]) for g in groups] == [
        ("a", 1, 20_000, "/p19999/"), ("a", 2, 1, "/"),
    ]


def test_final_attempts(spark):
    log = [
        ("a", 1, "timeout"), ("a", 2, "ok"), ("a", 3, "ok"),
        ("b", 1, "timeout"), ("b", 2, "connection"), ("b", 3, "request"), ("b", 4, "ok"),
        ("c", 1, "http"), ("c", 2, "ok"),
        ("d", 1, "connection"),
    ]
    rows = spark.createDataFrame(log, "url string, at int, outcome string")
    found = final_attempts(number_attempts(rows, "at", "outcome")).select("url", "attempt", "outcome", "waited_seconds")
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {
        "a": (2, "ok", 1.0), "b": (3, "request", 3.0), "c": (1, "http", 0.0), "d": (1, "connection", 0.0),
    }


def test_attempts_are_cut_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = number_attempts(events, "ts", "event_id", url="user_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_url_is_scanned_in_even_parts(spark):
    """Nine rows of ten are of one url and one hour, many of one instant, with few fetches among them."""
    start = 1_700_000_000
    asked = [(i, "hot" if i % 10 else f"u{i % 70}", start + (i * 7 % 3600 if i % 3 else 1800)) for i in range(6000)]
    stored = [("hot", start + t, t) for t in (5, 900, 1800, 3599)] + [(f"u{k}", start + 100, k) for k in range(70)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        r = spark.createDataFrame(asked, "id int, url string, s long").withColumn("requested_at", F.timestamp_seconds("s"))
        f = spark.createDataFrame(stored, "url string, s long, n long").withColumn("fetched_at", F.timestamp_seconds("s"))
        found = cached_fetch(r, f, 3600, payload=["n"])
        parts = found.groupBy(F.spark_partition_id()).count().collect()
        got = {x["id"]: x["cached_n"] for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, url, s in asked:
        before = [t for u, t, _ in stored if u == url and t <= s]
        assert got[i] == (None if not before else next(n for u, t, n in stored if u == url and t == max(before)))
    assert max(x["count"] for x in parts) < 6000 / 3


@pytest.mark.parametrize("seed", [1, 3])
def test_cached_fetch_matches_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    base = 1_700_000_000
    fetches = [(rng.choice("abc"), base + rng.randrange(40000) / 4, i) for i in range(300)]
    requests = [(i, rng.choice(["a", "b", "z", None]), base + rng.randrange(40000) / 4) for i in range(300)]
    requests += [(1000 + i, f[0], f[1] + 3600) for i, f in enumerate(fetches[:20])]
    to_time = lambda name: F.timestamp_micros((F.col(name) * 1e6).cast("bigint")).alias(name)
    f = spark.createDataFrame(fetches, "url string, fetched_at double, n int").select("url", to_time("fetched_at"), "n")
    r = spark.createDataFrame(requests, "id int, url string, requested_at double").select("id", "url", to_time("requested_at"))
    found = cached_fetch(r, f, 3600, payload=["n"]).select("id", F.unix_micros("cached_at") / 1e6, "cached_n").collect()
    assert len(found) == len(requests)
    times = {i: t for _, t, i in fetches}
    for id_, at, n in found:
        _, url, asked = next(q for q in requests if q[0] == id_)
        fitting = [t for u, t, _ in fetches if u == url and asked - 3600 <= t <= asked]
        assert at == (max(fitting) if fitting else None)
        assert (n is None) == (at is None) and (n is None or times[n] == at)


def walk(links, seeds, dead, max_depth, budget=None):
    """The reference traversal with a queue; depth per url."""
    queue, depth = deque((s, 0) for s in seeds), {}
    while queue:
        url, d = queue.popleft()
        if url in depth:
            continue
        depth[url] = d
        if url not in dead and d < max_depth:
            queue.extend((t, d + 1) for s, t in links if s == url)
    return depth


def graph(n=60):
    page = lambda i: f"https://h.example/{i % n}"
    return [(page(i), page(j)) for i in range(n) for j in (7 * i + 1, 3 * i + 2, i * i)] + [(page(5), page(k)) for k in range(n)]


def test_frontier_matches_a_queue(spark):
    links = graph()
    edges = spark.createDataFrame(links + links[:30], "src_url string, dst_url string")
    dead = {f"https://h.example/{i}" for i in (1, 2, 4)}
    fetches = spark.createDataFrame(
        [(u, "" if u in dead else "<p>", "e" if u in dead else None) for u in {s for s, _ in links}],
        "url string, html string, error string",
    )
    for depth in (0, 1, 3):
        found = crawl_frontier(edges, ["https://h.example/0#x", "https://h.example/9"], fetches, max_depth=depth, max_pages=None)
        rows = {r["url"]: r for r in found.collect()}
        expected = walk(links, ["https://h.example/0", "https://h.example/9"], dead, depth)
        assert {u: r["depth"] for u, r in rows.items()} == expected
        for url, row in rows.items():
            if row["depth"]:
                assert row["referer"] == min(s for s, t in links if t == url and s not in dead and expected.get(s) == row["depth"] - 1)


def test_frontier_budget_and_rules(spark, robots):
    links = [("https://star.example/", "https://star.example/a/no"), ("https://star.example/", "https://star.example/a/ok"),
             ("https://star.example/a/no", "https://star.example/b")]
    edges = spark.createDataFrame(links, "src_url string, dst_url string")
    groups, _ = parse_robots(robots)
    found = crawl_frontier(edges, ["https://star.example/"], groups=groups, agent="x", max_depth=3)
    assert {r["url"] for r in found.collect()} == {"https://star.example/", "https://star.example/a/ok"}
    many = spark.createDataFrame(graph(), "src_url string, dst_url string")
    full = crawl_frontier(many, ["https://h.example/5"], max_depth=2, max_pages=None)
    for budget in (1, 7, 30, 60, 100):
        cut = crawl_frontier(many, ["https://h.example/5"], max_depth=2, max_pages=budget).collect()
        assert len(cut) == min(budget, full.count())


def test_page_budget_takes_whole_levels_first(spark):
    rows = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 3).cast("int").alias("depth"))
    ordered = sorted((r["depth"], r["url"]) for r in rows.collect())
    for budget in (1, 1667, 1668, 2500, 4999, 5000, 9000):
        assert {r["url"] for r in page_budget(rows, budget).collect()} == {u for _, u in ordered[:budget]}


def test_numbers_have_no_gaps_in_many_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("a"), F.sha1(F.col("id").cast("string")).alias("b")).repartition(9)
    found = numbered(rows, ["a", "b"], "place").collect()
    ordered = sorted((r["a"], r["b"]) for r in found)
    assert sorted((r["place"], r["a"], r["b"]) for r in found) == [(k, *row) for k, row in enumerate(ordered)]
    assert numbered(rows.limit(0), ["a", "b"]).count() == 0


def test_order_of_a_crawl_and_its_budget(spark):
    links = spark.createDataFrame(graph(), "src_url string, dst_url string")
    full = crawl_frontier(links, ["https://h.example/5"]).collect()
    by_rule = sorted(full, key=lambda r: (r["depth"], r["url"]))
    assert [r["order"] for r in by_rule] == list(range(len(full)))
    cut = crawl_frontier(links, ["https://h.example/5"], max_pages=11).collect()
    assert {r["url"] for r in cut} == {r["url"] for r in by_rule[:11]}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_edges_are_joined_where_they_lie(spark):
    edges = spark.createDataFrame(graph(), "src_url string, dst_url string").withColumn("salt", F.lit(0))
    name = _bucketed(edges, 4)
    level = spark.createDataFrame([("https://h.example/5", 0)], "src_url string, salt int").hint("merge")
    plan = level.join(spark.table(name), ["src_url", "salt"])._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_no_level_passes_through_the_driver(spark, monkeypatch):
    plans = []
    kind = type(spark.range(1))
    stored = kind.checkpoint

    def spied(frame, *options):
        found = stored(frame, *options)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(kind, "checkpoint", spied)
    edges = spark.createDataFrame(graph(), "src_url string, dst_url string")
    fetches = edges.select(F.col("src_url").alias("url"), F.lit("x").alias("html"), F.lit("").alias("error"))
    found = crawl_frontier(edges, ["https://h.example/0"], fetches)
    assert found.count() > 1 and any("SortMergeJoin" in plan for plan in plans)
    assert not [plan for plan in plans if "BroadcastExchange" in plan]


def test_visits_count_repeated_discoveries(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "s")], "src_url string, dst_url string")
    found = crawl_frontier(edges, ["s"], max_depth=3, max_pages=None, dedupe=False)
    visits = {(r["url"], r["referer"]): r["visits"] for r in found.collect()}
    assert visits == {("s", None): 1, ("a", "s"): 1, ("b", "s"): 1, ("c", "a"): 1, ("c", "b"): 1, ("d", "c"): 2}


def test_nth_smallest(spark):
    hashed = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("h"))
    values = sorted(r["h"] for r in hashed.collect())
    for n in (1, 2, 777, 10000, 19999, 20000):
        assert nth_smallest(hashed, "h", n, digits=1) == values[n - 1]
    assert nth_smallest(hashed, "h", 20001) is None
    same = spark.range(6000).select(F.md5(F.lit("x")).alias("h"))
    assert nth_smallest(same, "h", 5) == nth_smallest(same, "h", 6000)


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    table = spark.createDataFrame([("hot", 1), ("950", 2)], "k string, v int")
    joined = salted_lookup(rows, table, "k", 7, F.col("id"))
    assert joined.count() == 1000 and joined.agg(F.sum("v")).first()[0] == 902
    small, large = lookup(rows, table, "k"), lookup(rows, table, "k", max_bytes=1)
    assert "_salt" not in small._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in large._jdf.queryExecution().executedPlan().toString()
    assert small.exceptAll(large.select(small.columns)).isEmpty()


def test_a_crawl_has_no_limits_unless_given(spark):
    chain = [(f"u{i}", f"u{i + 1}") for i in range(5)] + [("u0", f"w{i}") for i in range(150)]
    edges = spark.createDataFrame(chain, "src_url string, dst_url string")
    found = crawl_frontier(edges, ["u0"])
    assert found.count() == 156 and found.agg(F.max("depth")).first()[0] == 5
    for options in ({"max_pages": 3, "max_depth": 2}, {}):
        with pytest.raises(ValueError, match="budget"):
            crawl_frontier(edges, ["u0"], dedupe=False, **options)


RULES = "host string, rules array<struct<seq: int, allow: boolean, path: string>>, crawl_delay double"


def test_rules_by_index_equal_a_plain_scan(spark):
    generator = random.Random(3)

    def path(n):
        return "/" + "".join(generator.choices("ab/é*", k=generator.randrange(n)))

    hosts = {f"h{k}.example": [(i, generator.random() < 0.5, path(7)) for i in range(n)] for k, n in enumerate((0, 1, 2, 3, 40, 300))}
    hosts["h3.example"].append((99, False, "*"))
    hosts["h4.example"].insert(20, (100, True, ""))
    rules = spark.createDataFrame([(h, r, None) for h, r in hosts.items()], RULES)
    rows = [(f"https://{h}{path(9)}",) for h in [*hosts, "none.example"] for _ in range(200)]
    urls = spark.createDataFrame(rows, "url string").select("url", U.robots_path(F.col("url")).alias("path"))
    for row in apply_rules(urls, index_rules(rules)).collect():
        of_host = sorted(hosts.get(row["url"].split("/")[2], []))
        expected = next((allow for _, allow, p in of_host if p == "*" or row["path"].startswith(p)), True)
        assert row["allowed"] == expected, row


def test_many_rules_cost_little_more_than_few(spark):
    """A scan of 100,000 rules for each of 20,000 urls would compare two thousand million paths."""

    def seconds(n):
        rules = [(i, i % 3 == 0, f"/{i:06d}/") for i in range(n)]
        table = index_rules(spark.createDataFrame([("h.example", rules, None)], RULES)).checkpoint()
        urls = spark.range(20_000).select(F.format_string("https://h.example/%06d/x", F.col("id") % (2 * n)).alias("url"))
        found = apply_rules(urls, table).groupBy("allowed").count()
        start = time.perf_counter()
        counts = {r["allowed"]: r["count"] for r in found.collect()}
        assert counts[False] == sum(i % (2 * n) < n and i % (2 * n) % 3 != 0 for i in range(20_000))
        return time.perf_counter() - start

    shared_dir(spark)
    seconds(10)
    few, many = seconds(10), seconds(100_000)
    assert many < 5 * few + 15
