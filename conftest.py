"""Puts the repository on the path of tests, however they are started."""
