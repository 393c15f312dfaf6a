"""Relational operators over keyed frames."""
