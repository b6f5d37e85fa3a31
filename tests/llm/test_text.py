"""Licence automata and page extraction on hand-worked cases."""
from ledgermill.llm import htmltext, licenses


def test_licences():
    assert licenses.scan("x Released under the MIT License, under the mit license") == (10, 2, 2, 6, "mit", "mit", 1.0)
    assert licenses.scan("licensed under the GNU General Public License, version 3.")[4:6] == ("", "gpl-3")
    assert licenses.scan("licensed under the General Public License or any later version 3")[5] == ""
    assert licenses.scan("licensed under the general public license of any version 3")[5] == "gpl-3"
    assert licenses.scan(None) == (0, 0, None, None, "", "", 0.0)


def test_page():
    page = "<nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>One,  two<br>three<p>Four</article><div class='ad'>Buy</div><footer>f</footer><script>'</p>'</script>"
    assert htmltext.extract(page) == "T & x\nOne, two three\nFour"
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<p></p>") == ""
