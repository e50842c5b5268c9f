"""feedpulse.operators"""
