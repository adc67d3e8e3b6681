"""Readers: PDF objects, filters and page enumeration."""
