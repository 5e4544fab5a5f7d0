import itertools
import math
import random
import textwrap

import numpy as np
import pytest

from loomgraph.llm import spam_pages as sp

PROSE = "The worker writes each bucket once and checks the shard afterwards. If nothing is found, it returns an empty list. Older clients still send the header, which is why both places are read. "
CASES = {
    "tags": "alpha best, beta free, alpha cheap, beta online, gamma price, alpha buy, gamma top, beta review, alpha licence, gamma latest, beta crack, alpha full, gamma buy",
    "hashtags": "#alphabest #betafree #alphacheap #betaonline #gammaprice #alphabuy #gammatop #betareview #alphalicence #gammalatest #betacrack #alphafull",
    "links": "\n".join(f"- [thing {i}](https://a.example/x/{i})" for i in range(12)),
    "anchors": " | ".join(f'<a href="https://a.example/{i}">tool best</a><br>' for i in range(12)),
    "menu": "\n".join(["home page", "red shoes", "blue hats", "green socks", "contact", "about us", "sale items", "new goods", "login", "cart"] * 2),
    "stuffed": "Best tool kit for tool kit users. If you look for tool kit, tool kit is tool kit. Get tool kit now, the tool kit online tool kit. " * 3,
}
NOT = {
    "prose": PROSE * 3,
    "prose with links": PROSE * 3 + "See https://a.example/x for more. " + PROSE,
    "prose with tags": PROSE * 3 + "\nTags: alpha, beta, gamma",
    "code": "def f(x):\n    return g(x)\n\nclass A:\n    x = 1\n" * 6,
    "log": "\n".join(f"2025-01-0{i} 10:00 INFO Store - merged window {i}" for i in range(1, 9)),
    "trace": "Exception: x\n" + "\n".join(f"\tat a.b.C.d(C.java:{i})" for i in range(12)),
    "table": "| a | b |\n" + "\n".join(f"| value {i} | {i} |" for i in range(12)),
    "config": "\n".join(f"server.port{i} = {i}" for i in range(15)),
    "changelog": "\n".join(f"- The worker checks each bucket before it is written. ([#{i}](https://a.example/{i}))" for i in range(8)),
    "short": "a, b, c",
    "blank": " \n ",
}


@pytest.mark.parametrize(("name", "text"), [*((n, t) for n, t in CASES.items()), *((n, t) for n, t in NOT.items())])
def test_cases(spark, name, text):
    words = sp.label(text)
    n = sum(words)
    spam = n >= sp.LEAST_WORDS and sum(words[2:]) / n >= sp.SHARE
    assert spam == (name in CASES), words


# Plain news-like prose. No word list knows any of it.
LANGUAGES = {
    "English": "The council met on Tuesday evening and discussed the new bridge. Several residents asked when the work would begin. The mayor said that the first stones will be laid in spring.",
    "German": "Der Stadtrat tagte am Dienstagabend und sprach über die neue Brücke. Mehrere Anwohner fragten, wann die Arbeiten beginnen. Die Bürgermeisterin sagte, der Grundstein werde im Frühjahr gelegt.",
    "French": "Le conseil s’est réuni mardi soir pour parler du nouveau pont. Plusieurs habitants ont demandé quand les travaux commenceraient. Le maire a répondu que la première pierre serait posée au printemps.",
    "Spanish": "El consejo se reunió el martes por la noche y habló del puente nuevo. Varios vecinos preguntaron cuándo empezarán las obras. La alcaldesa dijo que la primera piedra se pondrá en primavera.",
    "Polish": "Rada miasta zebrała się we wtorek wieczorem i rozmawiała o nowym moście. Kilku mieszkańców pytało, kiedy rozpoczną się prace. Burmistrz odpowiedział, że pierwszy kamień zostanie położony wiosną.",
    "Czech": "Zastupitelstvo se sešlo v úterý večer a jednalo o novém mostě. Několik obyvatel se ptalo, kdy práce začnou. Starostka řekla, že základní kámen bude položen na jaře.",
    "Finnish": "Kaupunginvaltuusto kokoontui tiistai-iltana keskustelemaan uudesta sillasta. Useat asukkaat kysyivät, milloin työt alkavat. Kaupunginjohtaja vastasi, että peruskivi muurataan keväällä.",
    "Hungarian": "A városi tanács kedd este ülésezett, és az új hídról tárgyalt. Több lakos megkérdezte, mikor kezdődnek a munkák. A polgármester azt mondta, hogy az alapkövet tavasszal teszik le.",
    "Turkish": "Belediye meclisi salı akşamı toplandı ve yeni köprüyü görüştü. Birçok sakin çalışmaların ne zaman başlayacağını sordu. Başkan ilk taşın ilkbaharda konulacağını söyledi.",
    "Greek": "Το δημοτικό συμβούλιο συνεδρίασε το βράδυ της Τρίτης για τη νέα γέφυρα. Πολλοί κάτοικοι ρώτησαν πότε θα αρχίσουν τα έργα. Ο δήμαρχος απάντησε ότι ο θεμέλιος λίθος θα τεθεί την άνοιξη.",
    "Russian": "Городской совет собрался во вторник вечером и обсудил новый мост. Несколько жителей спросили, когда начнутся работы. Мэр ответил, что первый камень заложат весной.",
    "Arabic": "اجتمع مجلس المدينة مساء الثلاثاء وناقش الجسر الجديد. سأل عدد من السكان متى ستبدأ الأعمال. قال رئيس البلدية إن حجر الأساس سيوضع في الربيع.",
    "Hebrew": "מועצת העיר התכנסה ביום שלישי בערב ודנה בגשר החדש. כמה תושבים שאלו מתי יתחילו העבודות. ראש העיר השיב שאבן הפינה תונח באביב.",
    "Persian": "شورای شهر سه‌شنبه شب تشکیل جلسه داد و درباره پل جدید گفتگو کرد. چند نفر از ساکنان پرسیدند کار چه زمانی آغاز می‌شود. شهردار گفت که نخستین سنگ در بهار گذاشته خواهد شد.",
    "Hindi": "नगर परिषद की बैठक मंगलवार शाम को हुई और नए पुल पर चर्चा की गई। कई निवासियों ने पूछा कि काम कब शुरू होगा। महापौर ने कहा कि पहला पत्थर वसंत में रखा जाएगा।",
    "Korean": "시의회는 화요일 저녁에 모여 새 다리에 대해 논의했다. 여러 주민이 공사가 언제 시작되는지 물었다. 시장은 봄에 첫 돌을 놓을 것이라고 답했다.",
    "Japanese": "市議会は火曜日の夜に開かれ、新しい橋について話し合った。多くの住民が工事はいつ始まるのかと尋ねた。市長は春に最初の石を置くと答えた。",
    "Chinese": "市议会星期二晚上开会，讨论了新桥的建设问题。许多居民询问工程什么时候开始，市长回答说奠基仪式将在春天举行。会议持续了三个小时，没有人反对这项计划。",
    "Vietnamese": "Hội đồng thành phố họp vào tối thứ Ba và bàn về cây cầu mới. Nhiều người dân hỏi khi nào công việc sẽ bắt đầu. Thị trưởng nói rằng viên đá đầu tiên sẽ được đặt vào mùa xuân.",
    "Indonesian": "Dewan kota bertemu pada Selasa malam dan membahas jembatan baru. Beberapa warga bertanya kapan pekerjaan akan dimulai. Wali kota mengatakan batu pertama akan diletakkan pada musim semi.",
    "Swahili": "Baraza la jiji lilikutana Jumanne jioni na kujadili daraja jipya. Wakazi kadhaa waliuliza kazi itaanza lini. Meya alisema kwamba jiwe la kwanza litawekwa majira ya kuchipua.",
    "Thai": "สภาเมืองประชุมกันเมื่อเย็นวันอังคารเพื่อหารือเรื่องสะพานแห่งใหม่ ชาวบ้านหลายคนถามว่างานจะเริ่มเมื่อใด นายกเทศมนตรีตอบว่าจะวางศิลาฤกษ์ในฤดูใบไม้ผลิ",
}


def spam(text, model=sp.PRIOR_MODEL):
    words = sp.label(text, model)
    return sum(words) >= sp.LEAST_WORDS and sum(words[2:]) / sum(words) >= sp.SHARE


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(4)
    pages = [rng.choice(list(NOT.values())) if rng.random() < 0.8 else rng.choice(list(CASES.values())) for _ in range(400)]
    return sp.fit([sp.symbols(p)[0] for p in pages])


@pytest.mark.parametrize("language", LANGUAGES)
def test_prose_of_any_language(language, fitted):
    text = LANGUAGES[language]
    wrapped = "\n".join(textwrap.wrap(text * 2, 72))
    pages = (text, f"# {text.split()[0]}\n\n{text}") if language == "Thai" else (text, text * 3, wrapped, f"# {text.split()[0]}\n\n{text}")  # without marks, a repeated page looks like a list
    for page in pages:
        assert not spam(page) and not spam(page, fitted), sp.label(page)


@pytest.mark.parametrize("language", [x for x in LANGUAGES if x not in ("Japanese", "Chinese", "Thai")])
def test_keywords_of_any_language(language, fitted):
    words = [w.strip(".,،。।") for w in LANGUAGES[language].split()]
    rng = random.Random(5)
    goods = [w for w in words if len(w) > 2][:5]
    tags = " ".join(rng.choice(goods) for _ in range(150))
    listed = ", ".join(f"{rng.choice(goods)} {rng.choice(goods)}" for _ in range(60))
    for page in (tags, listed):
        assert spam(page) and spam(page, fitted)


@pytest.mark.parametrize("name", [*CASES, *NOT])
def test_cases_with_a_learned_model(name, fitted):
    assert spam((CASES | NOT)[name], fitted) == (name in CASES)


def test_viterbi_against_brute_force():
    m = sp.PRIOR_MODEL

    def score(observed, path):
        s = m.start[path[0]] + m.emission[observed[0]][path[0]]
        for a, b, o in zip(path, path[1:], observed[1:], strict=False):
            s += (m.stay if a == b else m.move) + m.emission[o][b]
        return s

    number = lambda *v: int(np.ravel_multi_index(v, sp.SIZES))
    plain, short, link, code, tag = number(0, 1, 2, 0, 0, 0), number(0, 0, 0, 0, 0, 0), number(2, 0, 1, 0, 0, 0), number(1, 0, 1, 0, 0, 0), number(0, 0, 4, 2, 2, 1)
    for observed in ([plain, short, plain, link], [short, short, short, code, plain], [link, link, plain, tag, tag], [code], [tag, tag, short]):
        best = max(score(observed, p) for p in itertools.product(range(5), repeat=len(observed)))
        assert math.isclose(score(observed, sp.viterbi(observed)), best)
    assert sp.viterbi([]) == []


def test_learning_raises_the_likelihood():
    rng = random.Random(6)
    pages = [sp.symbols(rng.choice([*CASES.values(), *NOT.values()]))[0] for _ in range(200)]
    pages = [p for p in pages if p]

    def likelihood(m):
        total = 0.0
        for p in pages:
            f = np.exp(np.array(m.start) + np.array(m.emission[p[0]]))
            moves = np.where(np.eye(5), np.exp(m.stay), np.exp(m.move))
            total += np.log(f.sum())
            f /= f.sum()
            for o in p[1:]:
                f = (f @ moves) * np.exp(np.array(m.emission[o]))
                total += np.log(f.sum())
                f /= f.sum()
        return total

    assert likelihood(sp.fit(pages)) > likelihood(sp.PRIOR_MODEL)
    assert sp.fit([]) is sp.PRIOR_MODEL and sp.fit([[], []]) is sp.PRIOR_MODEL


def test_table(spark):
    rows = [(1, CASES["tags"], 0.5), (2, None, 0.5), (3, "", 0.5), (4, PROSE, None), (1, CASES["tags"], 0.5), (5, "word " * 200_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double")
    got = sp.labelled_pages(df).collect()
    assert sorted(r["doc_id"] for r in got if r["spam"]) == [1, 1, 5]
    assert len(got) == 6
    assert sp.labelled_pages(df.limit(0)).count() == 0


def test_expected_counts_against_brute_force():
    rng = random.Random(7)
    m, combinations = sp.PRIOR_MODEL, len(sp.PRIOR_MODEL.emission)
    pages = [[rng.randrange(combinations) for _ in range(n)] for n in (4, 1, 3, 4, 2)]
    want = np.zeros((combinations + 1, 5))
    for page in pages:
        score = {}
        for path in itertools.product(range(5), repeat=len(page)):
            s = m.start[path[0]] + sum(m.emission[o][k] for o, k in zip(page, path, strict=True))
            score[path] = math.exp(s + sum(m.stay if a == b else m.move for a, b in itertools.pairwise(path)))
        for path, p in score.items():
            p /= sum(score.values())
            for o, k in zip(page, path, strict=True):
                want[o, k] += p
            want[-1, 0] += p * sum(a == b for a, b in itertools.pairwise(path))
        want[-1, 1] += len(page) - 1
    want[-1, 2] = len(pages)
    assert np.allclose(sp.expected([np.array(p) for p in pages], m), want)


def test_all_pages_and_all_units_are_learned_from(spark, monkeypatch):
    a, b, c = 3, 200, 500
    assert sp.fit([[a] * 64 + [b] * 64]) != sp.fit([[a] * 64 + [c] * 64])
    monkeypatch.setattr(sp, "PAGES", 5)
    texts = [x for _ in range(4) for x in (*CASES.values(), *NOT.values())]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    got, want = sp.learned(sp.units_of(df, "doc_id", "text")), sp.fit([sp.symbols(x)[0] for x in texts])
    assert np.allclose(got.emission, want.emission, atol=1e-5) and math.isclose(got.stay, want.stay, abs_tol=1e-5)
