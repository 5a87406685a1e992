"""Byte-level kernels without Spark: bytes in, plain values out. Faults are PdfError and never leave a Spark task."""
