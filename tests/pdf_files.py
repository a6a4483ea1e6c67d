"""Small PDF files, made byte by byte."""

import zlib


def pdf(objects, trailer="", version="1.4", xref=True):
    """A file of objects (number: body) with a classic cross-reference table; body may be bytes or str."""
    out = bytearray(f"%PDF-{version}\n".encode())
    at = {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    start = len(out)
    size = max(objects) + 1
    out += f"xref\n0 {size}\n0000000000 65535 f \n".encode()
    for n in range(1, size):
        out += f"{at[n]:010d} 00000 n \n".encode() if n in at else b"0000000000 00000 f \n"
    out += f"trailer\n<< /Size {size} /Root 1 0 R {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def stream(data, extra=""):
    data = data if isinstance(data, bytes) else data.encode("latin-1")
    return f"<< /Length {len(data)} {extra} >>\nstream\n".encode() + data + b"\nendstream"


def flat(data, extra=""):
    return stream(zlib.compress(data if isinstance(data, bytes) else data.encode("latin-1")), "/Filter /FlateDecode " + extra)


WIDTHS = "/FirstChar 32 /Widths [" + " ".join(["500"] * 95) + "]"


def one_page(content, page="", font=f"<< /Type /Font /Subtype /TrueType /BaseFont /Body /Encoding /WinAnsiEncoding {WIDTHS} >>", more=None, trailer="", catalog=""):
    objects = {
        1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>",
        2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /Im0 6 0 R /Fm0 7 0 R >> >> {page} >>",
        4: stream(content),
        5: font,
        6: stream(b"\0", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /DCTDecode"),
        7: stream("BT /F1 10 Tf 5 5 Td (in a form) Tj ET", "/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Matrix [1 0 0 1 50 60]"),
    }
    return pdf(objects | (more or {}), trailer)
