"""specula.operators"""
