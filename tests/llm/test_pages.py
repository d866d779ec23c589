from clausewright.llm import html_crf
from clausewright.llm.page_blocks import BlockParser
from clausewright.llm.page_samples import labelled_pages


def test_held_out_pages():
    data = html_crf.training_set(700)
    field = html_crf.train(data[:600])
    pairs = [(a, b) for rows, labels in data[600:] for a, b in zip(html_crf.decode(field, rows), labels)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.99
    assert labelled_pages(3) == labelled_pages(3)


def test_viterbi_is_the_best_path():
    import itertools

    field = html_crf.train(html_crf.training_set(60))
    rows = html_crf.training_set(61)[-1][0][:9]

    def value(path):
        total = field.start[path[0]] + sum(field.emit[k, y] for row, y in zip(rows, path) for k in row)
        return total + sum(field.move[a, b] for a, b in zip(path, path[1:]))

    assert html_crf.decode(field, rows) == list(max(itertools.product((0, 1), repeat=len(rows)), key=value))


def test_main_text_and_edge_cases(spark):
    field = html_crf.train(html_crf.training_set())
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a>"
        "<li><a>About</a></ul></nav><div class=\"ad\">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  part,\n of it.<br><p>Second&nbsp;one</p>"
        "<div class='comments'><p>Nice read!</p></div></article><footer>&copy; me &middot; us.</footer>"
    )
    rows = [(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, page[: page.index("Second") + 3], "x"), (5, "<script>only", "x"), (None, "< a", "x")]
    out = {r.page_id: r for r in html_crf.main_text(spark.createDataFrame(rows, "page_id long, html string, text string"), field).collect()}
    assert out[1].text == "A & B\nFirst part, of it.\nSecond one"
    assert out[4].text == "A & B\nFirst part, of it.\nSec"
    assert out[2].text == out[3].text == out[5].text == ""
    assert html_crf.main_text(spark.createDataFrame([], "html string"), field).isEmpty()


def test_parser_takes_any_input():
    parser = BlockParser()
    for text in ["<", "<a href='x", "<p", "a < b > c", "<!-- open", "</p></div>", "<p>" * 3000 + "deep", "<table><tr><td>1<td>2<tr><td>3", "&#0; &bogus; &am"]:
        parser(text)
    assert [b.text for b in parser("<table><tr><td>1<td>2<tr><td>3</table>")] == ["1", "2", "3"]


def test_silent_elements_without_a_closing_tag():
    parser = BlockParser()
    texts = lambda page: [b.text for b in parser(page)]
    for tag in ("<svg class=i />", "<object data='a' />", "<video src=x />", "<canvas/>", "<audio/>"):
        assert texts(f"<article><p>One {tag} two</p><p>Three</p></article>") == ["One two", "Three"], tag
    for tag in ("<button>Share", "<select><option>A<option>B", "<svg><path d='x'>", "<object data=x>", "<video src=x>", "<canvas>", "<template>"):
        assert texts(f"<article><div>One {tag}</div><p>Two</p>Three</article>End") == ["One", "Two", "Three", "End"], tag
        assert texts(f"<body>{tag}<article><p>Two</article>")[0] == "Two", tag
    assert texts("<p>One</p><button>Share <p>Two</p><button>No</button> three") == ["One", "Two", "three"]
    assert texts("<head><meta charset=x><div>One</div>") == ["One"]
    assert texts("<p>a <svg><title/><style/><g><text>no</text></g></svg> b <select><option>x</option></select>c") == ["a b c"]
    assert texts("<div>a <object><p>no</p><object>no</object>no</object> b</div>") == ["a b"]
    assert texts("<button><div>no</div></button>yes<head><p>no<body>ok") == ["yes", "ok"]
