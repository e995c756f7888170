"""Header parameters: tokens, quoted strings, escapes."""

import pytest

from spanscan.operators.attachments import parameters


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ("multipart/form-data; boundary=abc", {"boundary": "abc"}),
        ('multipart/form-data; charset=utf-8; Boundary="a b;c"; x=1', {"charset": "utf-8", "boundary": "a b;c", "x": "1"}),
        (r'form-data; name="a \"b\" \\ c"; filename="x;y=z.txt"', {"name": 'a "b" \\ c', "filename": "x;y=z.txt"}),
        ("form-data; name=one; name=two; ;=; flag; last = v ", {"name": "one", "last": "v"}),
        ('form-data; name="never closed', {"name": "never closed"}),
        ('form-data; name=""; filename*=x', {"name": "", "filename*": "x"}),
        ("form-data", {}),
        ("", {}),
    ],
)
def test_parameters(header, want):
    assert parameters(header) == want
