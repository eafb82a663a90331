"""Plain re-statements of the matchers, one line at a time, for comparison."""

import re

import ahocorasick


def fuzzy(line, keywords, max_insert):
    low = line.lower()
    for keyword in keywords:
        for match in re.finditer(".*?".join(map(re.escape, keyword)), low, re.DOTALL):
            if len(match.group()) <= len(keyword) + max_insert:
                return keyword, match.group()
    return None


def exact(line, keywords):
    automaton = ahocorasick.Automaton()
    for keyword in keywords:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    for _, keyword in automaton.iter(line):
        return keyword, keyword
    return None


def hits(text, config):
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        if config.is_fuzzy:
            hit = fuzzy(line, config.keyword_list, config.max_insert)
        else:
            hit = exact(line, config.keyword_list)
        if hit:
            out.append((number, hit[0], line.strip(), hit[1]))
    return out
