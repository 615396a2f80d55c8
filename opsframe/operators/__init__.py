"""Relational operators (J*, A*, W*, U* of the survey) as DataFrame functions."""
