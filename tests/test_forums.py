"""A golden topic, odd topics, and topics made of whole texts."""

from wikilake.operators import forums

PAGE = """<html><head><title>x</title></head><body><h1>A &amp; B - V2EX/go</h1><div class="header"><small class="gray"><a href="/member/ann">ann</a> · <span title="2023-10-06 14:15:08 +08:00">long ago</span> · 1,234 views</small></div>
<div class="topic_content"><div class="markdown_body"><p>Hello <b>all</b>x <img src="https://imgur.com/a.PNG?x" alt="pic" loading="lazy"></p></div></div>
<div id="r_1" class="cell"><span class="no">1</span><strong><a href="/member/bob">bob</a></strong><span class="ago" title="2023-10-07 01:02:03">x</span><div class="reply_content">one<br>two <img src="/local.png"><img src="http://h/b"></div></div>
<div id="r_2" class="cell"><span class="no">2</span><strong><a href="/member/ann">ann</a></strong><div class="badges"><div class="badge op">OP</div></div><span class="ago" title="">Oct 6, 2023</span><div class="reply_content">me</div></div>
<div id="r_3" class="cell"><span class="no">none</span><div class="reply_content">lost</div></div><div id="r_4" class="cell"><span class="no">4</span><div class="reply_content"> </div></div><div id="r_5" class="inner"><span class="no">5</span><div class="reply_content">no cell</div></div></body></html>"""


def frame(spark, *pages):
    return spark.createDataFrame([(k, f"https://v2ex.com/t/{k}", p) for k, p in enumerate(pages)], "key int, url string, html string")


def test_a_golden_topic(spark):
    pages = frame(spark, PAGE)
    [got] = forums.rendered(pages).collect()
    assert (got.title, got.posts, got.pictures) == ("A & B", 3, 2)
    assert got.markdown == (
        "# A & B\n\n> 原文链接: https://v2ex.com/t/0\n> 主题元信息: 共 3 楼 · 1234 浏览\n\n---\n\n## #1 @ann · 2023-10-06\n\nHello **all** x ![pic](v2ex-001-01.png)\n\n"
        "## #2 @bob · 2023-10-07\n\none\ntwo ![](/local.png)![](v2ex-002-01.jpg)\n\n## #3 @ann · Oct 6, 2023  (OP comment)\n\nme\n"
    )
    pictures = [(r.no, x.place, x.remote, x.local) for r in forums.posts(forums.parts(pages)).collect() for x in r.pictures]
    assert sorted(pictures) == [(1, 1, "https://i.imgur.com/a.PNG?x", "v2ex-001-01.png"), (2, 1, "http://h/b", "v2ex-002-01.jpg")]


def test_odd_topics(spark):
    many = "<title>T – V2EX</title><div class='topic_content'>plain</div>" + "".join(f"<div id='r_{k}' class='cell x'><span class='no'> {k} </span><div class='reply_content'>say {k}</div></div>" for k in range(300))
    got = {r.key: r for r in forums.rendered(frame(spark, None, "", "<h1>only a title</h1>", many)).collect()}
    assert set(got) == {3} and got[3].title == "T" and got[3].posts == 301
    assert got[3].markdown.startswith("# T\n\n> 原文链接: https://v2ex.com/t/3\n> 主题元信息: 共 301 楼\n\n---\n\n## #1 @anonymous\n\n") and got[3].markdown.endswith("## #300 @anonymous\n\nsay 299\n")
