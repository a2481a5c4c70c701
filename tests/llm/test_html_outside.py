"""Pages written by hand, none of them from the generator of training pages."""

from orbweave.llm.html_extract import fit, main_text

A = "Rivers carry sand, silt and stones towards the sea, and where the slope eases they let them fall. Over centuries such deposits build plains on which most people live."
B = "Farmers have long known that these soils are deep and rich; floods renew them. Dams stop both the flood and the renewal, which is why yields fall below them."
C = "A short survey of twelve rivers showed the same pattern, with few exceptions."


def test_frame_of_elements():
    page = f"<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><main><h1>On rivers</h1><p>{A}</p><p>{B}</p></main><footer>Copyright 2020 <a href=/i>Imprint</a></footer></body></html>"
    assert main_text(page, fit()).split("\n\n") == ["On rivers", A, B]


def test_frame_of_divs_with_open_tags():
    page = f"""<body><div class='site-header'><ul class=menu><li><a href=/>Start</a><li><a href=/about>About us</a></ul></div>
    <div id=content><div class='post-body'><h2>On rivers</h2><p>{A}<p>{B}<p>{C}</div>
    <div id=comments><h3>Comments</h3><div class=comment><p>Great text, thank you very much for writing it!</p></div></div></div>
    <div class='sidebar widget'><h4>Popular</h4><ul><li><a href=1>Ten lakes</a></li></ul></div></body>"""
    assert main_text(page, fit()).split("\n\n") == ["On rivers", A, B, C]
