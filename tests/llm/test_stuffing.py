import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from biosignal.llm.stuffing import Facts, Pages, body, covered, keywords, longest_repeats, measures, stuffed_pages, suffix_classes

LETTERS = [f"{c}{v}" for c in "bcdfgklmnprst" for v in "aeiou"]
TALK = "I drew a plan for the new shed, threw it away and painted the old one instead. Does anyone here know where my neighbour bought the hinges? It rained all weekend, so we had to wait. Thanks for the photos, they helped me a lot. "
SPAM = {
    "keywords": "cheap yoga mat, best yoga mat, yoga mat sale, buy yoga mat online, yoga mat outlet, discount yoga mat, yoga mat review, cheap yoga mat deal",
    "links": "\n".join(f"http://shop{k}.example/p/{k * 37}" for k in range(12)),
    "bbcode": "<br>".join(f"[url=http://www.s{k}.test/x]buy lamp {k}[/url]" for k in range(12)),
    "tags": " ".join(["#yoga_mat #sale #cheap #ledlamp #best #dogbed #yogamat #outlet"] * 3),
    "table": "\n".join(f"{p} | Name{k} | XL | {k * 17}.50 | #{k * 991} | {w}" for k, (p, w) in enumerate([("dog bed", "sale"), ("led lamp", "buy"), ("wool socks", "best"), ("dog bed", "cheap"), ("yoga mat", "coupon")] * 2)),
    "sentences": " ".join(["Compare yoga mat prices, read yoga mat reviews, get yoga mat today.", "When you want a yoga mat, order the yoga mat from our yoga mat shop.", "Every yoga mat lover loves a yoga mat from the yoga mat store."] * 3),
    "surrounded": TALK[:79] + "\n\n\n" + ", ".join(f"cheap lamp, http://a{k}.example/x, sale mat" for k in range(12)),
}
FINE = {
    "talk": TALK,
    "links in talk": TALK + "See http://a.example/x and www.b.example for more.\n-- \nMy page: http://me.example",
    "readings": TALK + "\n" + "\n".join(f"{k}.{k}. 1{k % 10}:2{k % 10}  {k * 3}.5  dry" for k in range(1, 13)),
    "list": TALK + "\nTags: hinge, shed, paint\n- two hinges\n- a brush",
    "word": TALK + "The shed is old. My shed leaks. Your shed is fine, but the shed of my uncle is not.",
    "quoted spam": "> " + "\n> ".join(SPAM["keywords"].split(", ")) + "\nPlease do not post this here again, it is not what we want to read.",
    "quote tags": "[quote=x][quote=y]" + SPAM["keywords"] + "[/quote]" + SPAM["keywords"] + "[/quote]\n" + TALK,
    "german": "Wer hat Erfahrung mit so etwas und wohnt in der Nähe von Wenka? Bei mir war der Griff nach 80 Tagen wieder in Ordnung. Wer hat Erfahrung mit so etwas und wohnt in der Nähe von Grava? Bei mir war die Pumpe nach 85 Tagen wieder in Ordnung.",
    "short": "+1",
}


def pages(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y") for k, t in texts.items()], "doc_id string, text string, id string, chars string")


def test_spam_and_talk(spark):
    out = {r.id: r.is_stuffed for r in stuffed_pages(pages(spark, {**SPAM, **FINE})).collect()}
    assert {k for k, v in out.items() if v} == set(SPAM)


def test_nulls_empty_and_repeats(spark):
    d = pages(spark, {"a": None, "b": "", "c": " \n ", "d": "\x00\x01\x02", "e": "[quote]"})
    out = stuffed_pages(d.union(d)).collect()
    assert len(out) == 10 and not any(r.is_stuffed for r in out)
    assert stuffed_pages(d.where("false")).count() == 0
    assert stuffed_pages(d.withColumn("doc_id", F.lit(None).cast("string"))).count() == 0


def naive(tokens):
    n, out = len(tokens), []
    for i in range(n):
        best = 0
        for k in range(1, n - i + 1):
            if sum(tokens[a : a + k] == tokens[i : i + k] for a in range(n - k + 1)) >= 2:
                best = k
        out.append(best)
    return out


def test_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        texts = [[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 6))]
        page = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        token = np.array([x for t in texts for x in t], int)
        got = longest_repeats(page, suffix_classes(page, token))
        assert got.tolist() == [x for t in texts for x in naive(t)]


def test_keywords_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        texts = [[rng.randrange(5) for _ in range(rng.randrange(0, 30))] for _ in range(4)]
        page, token = np.repeat(np.arange(4), [len(t) for t in texts]), np.array([x for t in texts for x in t], int)
        size, allowed, edge = 3.0 + token, token != 4, token != 3
        begins, phrase, times = keywords(page, 4, size, allowed, edge, suffix_classes(page, token))
        at = 0
        for p, t in enumerate(texts):
            best = max([0.0, *(n * (sum(g) + 3 * len(g)) for k in (1, 2, 3, 4) for g in {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if 4 not in g and 3 not in (g[0], g[-1]) for n in [sum(tuple(t[i : i + k]) == g for i in range(len(t) - k + 1))] if n >= 3)])
            own = slice(at, at + len(t))
            at += len(t)
            if not best:
                assert times[p] == 0 and not phrase[own].any()
                continue
            first = int(np.flatnonzero(begins[own])[0])
            k = 1
            while sum(tuple(t[i : i + k]) == tuple(t[first : first + k]) for i in range(len(t) - k + 1)) * (sum(t[first : first + k]) + 3 * k) != best:
                k += 1
            assert begins[own].tolist() == [tuple(t[i : i + k]) == tuple(t[first : first + k]) for i in range(len(t))] and times[p] == begins[own].sum()


def test_cover():
    assert covered(np.array([0, 0, 2, 0, 1, 3]), np.array([True] * 5 + [False])).tolist() == [False, False, True, True, True, False]


OTHER_TALK = {
    "russian": "Вчера мы ходили в парк и долго гуляли там, потому что погода была хорошая. Потом мы зашли в кафе и выпили чаю с пирогами, а потом пошли в кино и смотрели фильм о море. Мой брат рассказал, как он ездил на море в прошлом году, и мы долго смеялись над его рассказом о море. Если завтра не будет дождя, то мы снова пойдём гулять, только возьмём с собой собаку. Собака у брата большая, но добрая, и она любит гулять в парке.",
    "polish": "Wczoraj byliśmy w parku i długo tam spacerowaliśmy, bo pogoda była ładna. Potem poszliśmy do kawiarni i wypiliśmy herbatę. Mój brat opowiadał, jak był nad morzem w zeszłym roku, i długo się śmialiśmy. Jeśli jutro nie będzie padać, to znowu pójdziemy na spacer.",
    "dutch": "Gisteren waren we in het park en we hebben daar lang gewandeld, want het weer was mooi. Daarna gingen we naar het café en dronken we thee. Mijn broer vertelde hoe hij vorig jaar naar zee ging, en we hebben lang gelachen. Als het morgen niet regent, gaan we weer wandelen.",
    "chinese": "昨天我们去了公园，在那里走了很久，因为天气很好。后来我们去咖啡馆喝了茶。我哥哥讲了他去年去海边的事，我们笑了很久。如果明天不下雨，我们还会去散步，并且带上狗。",
    "japanese": "昨日は公園に行って、天気がよかったので長いあいだ散歩しました。そのあと喫茶店でお茶を飲みました。兄は去年海に行った話をして、みんなで笑いました。",
}
OTHER_SPAM = {
    "six tags": "#buy #now #cheap #sale #best #price",
    "chinese without spaces": "便宜手机便宜手机壳便宜手机膜" * 4,
    "thai": "รองเท้าราคาถูกรองเท้าวิ่งราคาถูกรองเท้าผ้าใบราคาถูกรองเท้าแตะราคาถูก",
    "run together": "cheapshoescheapshoesonlinecheapshoessalecheapshoesbuycheapshoescheapshoesoutletcheapshoesbest",
    "russian": "купить лампу, лампа дешево, лампа отзывы, лампа цена, купить лампу онлайн, лампа скидка, лампа купить дешево",
}


@pytest.mark.parametrize("stops", [True, False])
def test_languages_without_a_list_of_words(spark, stops):
    talk = OTHER_TALK if stops else {k: t.lower().translate({ord(c): None for c in ".,!?，。、"}) for k, t in OTHER_TALK.items()}
    out = {(r.id, r.chars > 0): r.is_stuffed for r in stuffed_pages(pages(spark, {f"t{k}": v for k, v in talk.items()} | {f"s{k}": v for k, v in OTHER_SPAM.items()})).collect()}
    assert {k[0] for k, v in out.items() if v} == {f"s{k}" for k in OTHER_SPAM}


def test_very_long_page_is_read_whole():
    began = time.time()
    text = TALK * 2000 + SPAM["keywords"] * 8000
    m = measures(text)
    assert m[0] > 1_500_000 and m[1] > 0.5
    assert measures(SPAM["keywords"] * 500 + TALK * 2000)[1] < 0.5
    assert time.time() - began < 120


def test_phrases_far_apart_on_a_long_page():
    names = " ".join(f"{a}{b}{c}" for a in LETTERS[:16] for b in LETTERS for c in LETTERS)
    # 51,200 different names listed twice
    names = " ".join(f"{n}{x}" for n in names.split()[:12800] for x in ("ba", "be", "bi", "bo"))
    m = measures(names + "\n" + names)
    assert m[1] > 0.99 and m[2] > 0.99


def test_one_keyword_on_a_long_page():
    # the keyword of each part recurs less than six times, the parts together have six
    own = " ".join(f"{a}{b}{c}na" for a in LETTERS for b in LETTERS[:40] for c in LETTERS[:40])
    line = "the best {0} shop sells a {0}. "
    pages = Pages()
    pages.add(line.format("lamp") * 2 + "\n" + own + "\n" + line.format("mat") * 2)
    _, key, size, _ = pages.numbered(Facts())
    page = np.zeros(len(key), int)
    assert keywords(page, 1, size, key >= 0, size > 2, suffix_classes(page, key))[2].tolist() == [4]


def test_body():
    assert body("> a\nb\n-- \nsig").strip() == "b"
    assert body("[quote=a]x[quote=b]y[/quote]z[/quote]own").strip() == "own"


def test_tags_without_their_other_half_are_no_quotes(spark):
    for tag in ("[quote]", "[quote=x]", "<blockquote>", "[/quote]", "</blockquote>", "[quote]a[/quote][quote]", "<blockquote>a[/quote]"):
        assert SPAM["keywords"] in body(f"x {tag}\n{SPAM['keywords']}"), tag
    assert body("[quote]a[quote]b[/quote]own").split() == ["a", "own"]
    assert body("[quote]a<blockquote>b[/quote]c</blockquote>own").split() == ["own"]
    assert body("[quote]a<blockquote>b[/quote]own").split() == ["own"]
    texts = {k: f"{tag}\n{SPAM[k]}" for k, tag in (("keywords", "[quote=x]"), ("links", "<blockquote class='a'>"))}
    assert all(r.is_stuffed for r in stuffed_pages(pages(spark, texts)).collect())


def test_rows_of_a_table_are_no_quotes():
    table = "\n".join(f"| {row} |" for row in SPAM["table"].split("\n"))
    assert body(table) == table and measures(table)[1] > 0.5
    assert body("| dog bed | 3 |\n| a quote\n| | of a quote\n | > of a quote\nown").split() == "| dog bed | 3 | own".split()
    assert body("|\nown").split() == ["|", "own"]


def test_long_links_count_whole():
    links = "\n".join(f"http://shop{k}.example/{'a1' * 490}" for k in range(5))
    prose = TALK * 6
    chars, stuffing, _, clauses = measures(prose + "\n" + links)
    whole = len(prose) + len(links)
    assert abs(chars - whole) < 40 and abs(stuffing - len(links) / whole) < 0.02 and abs(clauses - len(prose) / whole) < 0.02
