"""Readers and parsers: article-shaped views, feeds, pages and story lists."""
