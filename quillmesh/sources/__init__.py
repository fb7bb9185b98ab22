"""Packages, archives and uploads as rows."""
