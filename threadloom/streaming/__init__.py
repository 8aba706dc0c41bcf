"""Conversations as streams: the per-turn plans over keyed state."""
