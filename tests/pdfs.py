"""Small documents for the tests, by the package's writer."""

from inkspark.sources.kernel import rows
from inkspark.sources.writer import File, simple_font


def one_page(content, resources=None, page="", compress=True, objects=(), how="table", font=None):
    """A page of raw content; ``objects``: more object bodies, from number 10 on."""
    f = File()
    f.add("<< /Type /Catalog /Pages 2 0 R >>")
    f.add("<< /Type /Pages /Count 1 /Kids [5 0 R] >>")
    f.add(font or simple_font())
    f.stream(content if isinstance(content, bytes) else content.encode("latin-1"), compress=compress, num=4)
    box = "" if "/MediaBox" in page or "NOBOX" in page else "/MediaBox [0 0 612 792]"
    f.add(f"<< /Type /Page /Parent 2 0 R {box} /Contents 4 0 R /Resources {resources or '<< /Font << /F1 3 0 R >> >>'} {page.replace('NOBOX', '')} >>")
    for i, body in enumerate(objects):
        if isinstance(body, tuple):
            f.stream(body[0], body[1], num=10 + i)
        else:
            f.add(body, 10 + i)
    if how == "packed":
        return f.cross_stream(1, packed=[1, 2, 3, 5])
    if how == "stream":
        return f.cross_stream(1)
    return f.table(1, {"cr": b"\r", "crlf": b"\r\n"}.get(how, b"\n"))


def of_kind(data, kind, **options):
    return [v for k, v in rows(data, **options) if k == kind]
